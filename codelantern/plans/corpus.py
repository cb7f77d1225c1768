"""The driver tables seen through the chunk model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelantern.config import GenerationOptions
from codelantern.functions.text import count_lines, extension
from codelantern.operators.models import ExtractiveModel
from codelantern.operators.sizing import spread

N_REPOS = 20
DIRECTORIES = ("src", "lib/core", "docs", "app", "node_modules/pkg", "src/tests", "Docs", "pkg/util")
EXTENSIONS = (
    ".py", ".ts", ".md", ".js", ".go", ".txt", ".rs", ".json", ".PNG", ".min.js", "", ".lock", ".tsx",
    ".mdx", ".JAVA", ".html", ".xyz",
)
SPECIAL_NAMES = {97: "package-lock.json", 89: "README", 83: "LICENSE", 79: ".gitignore", 73: ".eslintrc.json"}
#: The line of a document that becomes a damaged block of code: brackets stay open.
DAMAGED = 50
KINDS = ("function", "class", "method", "module", "doc")


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(doc_id: Column, lang: Column) -> Column:
    name = F.concat(lang, F.lit("_"), doc_id.cast("string"), _pick(EXTENSIONS, doc_id))
    for divisor, special in SPECIAL_NAMES.items():
        name = F.when(doc_id % divisor == 0, F.lit(special)).otherwise(name)
    return F.concat(_pick(DIRECTORIES, F.floor(doc_id / 3)), F.lit("/"), F.lit("d"), doc_id.cast("string"),
                    F.lit("/"), name)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, repo_id, path, size_bytes, content)``; one file per document."""
    doc = table(spark, sf_dir, "documents")
    return doc.select(
        "doc_id", F.col("source").alias("repo_id"), path_of(F.col("doc_id"), F.col("lang")).alias("path"),
        F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"),
    )


def chunk_columns(rows: DataFrame) -> DataFrame:
    """Every file as one chunk, in document order."""
    doc_id = F.col("doc_id")
    return rows.select(
        doc_id.cast("string").alias("id"), "repo_id", F.col("path").alias("file_path"),
        F.lit("text").alias("language"), "content",
        F.lit(1).alias("start_line"), count_lines(F.col("content")).alias("end_line"),
        F.concat(F.lit("doc_"), doc_id.cast("string")).alias("symbol_name"),
        _pick(KINDS, doc_id).alias("symbol_type"), doc_id.alias("ord"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(spread(files(spark, sf_dir), "doc_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo_id, id, ord, embedding)``: the embedding with a document's number, where there is one."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return files(spark, sf_dir).select("doc_id", "repo_id").join(stored, "doc_id").select(
        "repo_id", F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), "embedding"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ``benchmark`` passage asked of one repository, with the vector of the same number.

    Some ask an unknown repository and some ask for the file inventory, so refusals and the inventory's way past them occur.
    """
    number = F.col("item_id")
    known = F.concat(F.lit("src"), (number % N_REPOS).cast("string"))
    counting = F.concat(F.lit("How many files say "), "text")
    item = table(spark, sf_dir, "benchmark").select(
        number.alias("query_id"), F.when(number % 10 == 7, "none/such").otherwise(known).alias("repo_id"),
        F.when((number % 5 == 3) | (number % 20 == 17), counting).otherwise(F.col("text")).alias("text"),
    )
    asked = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return item.join(asked, "query_id", "left")


# -- texts derived from whole tables, for operators whose input the tables lack ---------------
def _headed_text() -> Column:
    def head(line: Column, i: Column) -> Column:
        return F.when(i % 4 == 2, F.concat(F.lit("# "), line)).otherwise(line)

    return F.array_join(F.transform(F.split("content", "\n"), head), "\n")


def headed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: every fourth line becomes a header."""
    return spread(files(spark, sf_dir), "doc_id").withColumn("content", _headed_text())


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the kind of file that their path names: Python, TypeScript, else text with headers."""
    ext = extension(F.col("path"))
    text = F.when(ext == ".py", _code_text(_python_block)).when(ext == ".ts", _code_text(_script_block)).otherwise(_headed_text())
    return spread(files(spark, sf_dir), "doc_id").withColumn("content", text)


def _quoted_lines() -> Column:
    return F.transform(F.split("content", "\n"), lambda line: F.regexp_replace(line, "[^a-zA-Z0-9 ,.]+", " "))


def _code_text(block) -> Column:
    def shape(i: Column) -> Column:
        return F.when(i == DAMAGED, -1).otherwise(i % 5)

    return F.array_join(F.transform(_quoted_lines(), lambda line, i: block(line, i.cast("string"), shape(i))), "\n")


def _source_files(spark: SparkSession, sf_dir: str, suffix: str, block) -> DataFrame:
    text = _code_text(block)
    return spread(files(spark, sf_dir), "doc_id").select(
        "repo_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), text.alias("content")
    )


def _python_block(line: Column, i: Column, kind: Column) -> Column:
    return (
        F.when(kind == 0, F.concat(F.lit("class C"), i, F.lit(":\n    def m"), i, F.lit("(self):\n        return '"), line, F.lit("'")))
        .when(kind == 1, F.concat(F.lit("@deco([{1: 2}])\nasync def g"), i, F.lit("(x=(1, [2])): # (\n    return '"), line, F.lit("'")))
        .when(kind == -1, F.concat(F.lit("def broken"), i, F.lit("(x):\n    y = [(\n    '"), line, F.lit("'")))
        .otherwise(F.concat(F.lit("def f"), i, F.lit("(x):\n    y = '"), line, F.lit("'\n    return y")))
    )


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a three-line function or class; a damaged one in long documents."""
    return _source_files(spark, sf_dir, ".py", _python_block)


def _script_block(line: Column, i: Column, kind: Column) -> Column:
    return (
        F.when(kind == 0, F.concat(F.lit("class C"), i, F.lit(" {\n  m"), i, F.lit("(a) { return '"), line, F.lit("'; }\n}")))
        .when(kind == 1, F.concat(F.lit("function f"), i, F.lit("(x) {\n  return `"), line, F.lit(" ${x}`; // }\n}")))
        .when(kind == 2, F.concat(F.lit("const a = '"), line, F.lit("', h"), i, F.lit(" = async (x = f(g([{}]))) => {\n  return a;\n}, b = 1;")))
        .when(kind == 3, F.concat(F.lit("class S"), i, F.lit(" {\n  static 'k "), i, F.lit("'<T>(a: T): { b: T } { return '"), line, F.lit("'; }\n}")))
        .when(kind == -1, F.concat(F.lit("function broken"), i, F.lit("(x = [ {\n  (\n  '"), line, F.lit("'")))
        .otherwise(F.concat(F.lit("const g"), i, F.lit(" = (x) => {\n  return \""), line, F.lit(" {\";\n};")))
    )


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a class, a function or a variable of three lines; a damaged one in long documents."""
    return _source_files(spark, sf_dir, ".ts", _script_block)


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per document: its text with citation tags and symbol mentions added."""
    d, path = F.col("doc_id"), F.col("path")

    def s(column: Column) -> Column:
        return column.cast("string")

    tail = F.concat(
        F.lit("\nUses ["), path, F.lit(":1-3] and [d"), s(d), F.lit("/x.ts:4] then 【"), F.upper(path), F.lit(":"),
        s(d % 7), F.lit("-"), s(d % 11), F.lit("】 or ["), F.right(path, F.lit(4)), F.lit(":2], again ["), path,
        F.lit(":1-3] [missing.go:"), s(d), F.lit("]. See doc_"), s(d), F.lit("() before doc_"), s(d * 13 % 1000),
        F.lit("() Note: helper_fn () return: doc_"), s(d), F.lit("()"),
    )
    return spread(files(spark, sf_dir), "doc_id").select(d.alias("answer_id"), F.concat("content", tail).alias("text"))


def answer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two retrieved chunks per answer: the document of the same number, then the next one."""
    rows = chunk_columns(files(spark, sf_dir))
    own = rows.select(F.col("ord").alias("answer_id"), F.lit(1).alias("rank"), "*")
    following = rows.select((F.col("ord") - 1).alias("answer_id"), F.lit(2).alias("rank"), "*")
    return own.unionByName(following).where(F.col("answer_id") >= 0)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol to look up per ``benchmark`` passage: a symbol, a path part, a word or a common ending."""
    item = F.col("item_id")
    kind, number = item % 4, item.cast("string")
    symbol = (
        F.when(kind == 0, F.concat(F.lit("DOC_"), number)).when(kind == 1, F.concat(F.lit("d"), number))
        .when(kind == 2, F.split_part("text", F.lit(" "), F.lit(1))).otherwise("ts")
    )
    return table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"), F.concat(F.lit("src"), (item % N_REPOS).cast("string")).alias("repo_id"),
        symbol.alias("symbol"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming chunks: labelled documents with their label added, and every passage as a new chunk."""
    revised = chunks(spark, sf_dir).join(
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality"), "ord"
    ).select("id", "repo_id", F.concat("content", F.lit(" q="), F.col("quality").cast("string")).alias("content"))
    item = F.col("item_id")
    passages = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), item.cast("string")).alias("id"),
        F.concat(F.lit("src"), (item % N_REPOS).cast("string")).alias("repo_id"), F.col("text").alias("content"),
    )
    return revised.unionByName(passages)


def _stored_columns(rows: DataFrame) -> DataFrame:
    """Chunks as the store takes them: an embedding, and a store order that sorts as text."""
    order = F.lpad(F.col("ord").cast("string"), 12, "0")
    return rows.withColumn("ord", order).withColumn("embedding", F.array(F.lit(1.0).cast("float")))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_columns(chunks(spark, sf_dir))


def stored_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert: labelled documents with their label added, and every passage as a note of its own."""
    label = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), "quality")
    revised = chunks(spark, sf_dir).join(label, "ord").withColumn(
        "content", F.concat("content", F.lit(" q="), F.col("quality").cast("string"))).drop("quality")
    item = F.col("item_id")
    notes = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), item.cast("string")).alias("id"), F.concat(F.lit("src"), (item % N_REPOS).cast("string")).alias("repo_id"),
        F.concat(F.lit("notes/n"), item.cast("string"), F.lit(".md")).alias("file_path"), F.lit("text").alias("language"),
        F.col("text").alias("content"), F.lit(1).alias("start_line"), count_lines(F.col("text")).alias("end_line"),
        F.lit(None).cast("string").alias("symbol_name"), F.lit("doc").alias("symbol_type"), (item + 10**9).alias("ord"))
    return _stored_columns(revised.select(*notes.columns).unionByName(notes))


class MentioningModel(ExtractiveModel):
    """The extractive model with a mention of one more symbol, so that answers need a hop."""

    def answer(self, prompts: DataFrame, options: GenerationOptions | None = None) -> DataFrame:
        symbol = F.concat(F.lit(" calls doc_"), (F.col("query_id") * 37 % 500).cast("string"), F.lit("()"))
        return super().answer(prompts, options).withColumn("text", F.concat("text", symbol))
