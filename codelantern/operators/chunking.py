"""From files to chunks.  A file is one row; only the texts of code files are shuffled, once, to find their symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.functions.text import (
    SPACE_CLASS,
    LINE_BREAK,
    basename,
    count_lines,
    extension,
    is_blank,
    language_of,
    trim_space,
)
from codelantern.operators.symbols import python_symbols, script_symbols

_HEADER = f"^{fv.MARKDOWN_HEADER}[{SPACE_CLASS}]+([^\\n\\r\\x{{2028}}\\x{{2029}}]+)\\z"


def route_of(path: Column) -> Column:
    """``doc`` for Markdown, ``code`` for a language with an extractor, ``module`` for the rest."""
    markdown = extension(path).isin(*fv.MARKDOWN_EXTENSIONS) | (F.lower(basename(path)) == "readme")
    return (
        F.when(markdown, "doc").when(language_of(path).isin(*fv.PARSED_LANGUAGES), "code").otherwise("module")
    )


def _with_sections(files: DataFrame, is_doc: Column) -> DataFrame:
    """Add ``sections``: the header-delimited parts of each Markdown text, blank ones left out.

    Everything happens inside the row with array functions.  Each step is a
    column of its own, since an expression used in a lambda is evaluated per element.
    """
    lines = files.withColumn("lines", F.when(is_doc, F.split("content", LINE_BREAK)))
    marked = lines.withColumn(
        "starts",
        F.array_union(
            F.array(F.lit(1)),
            F.filter(
                F.transform("lines", lambda line, i: F.when(line.rlike(_HEADER), i + 1)),
                lambda n: n.isNotNull(),
            ),
        ),
    ).withColumn("n_lines", F.size("lines"))

    def section(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(F.col("starts"), i + 1) - 1, F.col("n_lines"))
        head = F.element_at("lines", start)
        title = F.when(head.rlike(_HEADER), trim_space(F.regexp_extract(head, _HEADER, 1)))
        return F.struct(
            F.coalesce(title, F.lit("Documentation")).alias("symbol_name"), F.lit("doc").alias("symbol_type"),
            start.alias("start_line"), stop.alias("end_line"),
            trim_space(F.array_join(F.slice("lines", start, stop - start + 1), "\n")).alias("content"),
            F.lit(0).alias("twin"),
        )

    return marked.withColumn(
        "sections", F.when(is_doc, F.filter(F.transform("starts", section), lambda s: F.length(s["content"]) > 0))
    ).drop("lines", "starts", "n_lines")


def _exploded(files: DataFrame, pieces: Column, language: Column) -> DataFrame:
    rows = files.select("repo_id", "path", language.alias("language"), F.posexplode_outer(pieces).alias("seq", "piece"))
    twin = F.when(F.col("piece.twin") > 0, F.concat(F.lit("#"), (F.col("piece.twin") + 1).cast("string")))
    return rows.where(F.col("piece").isNotNull()).select(
        F.concat(
            "repo_id", F.lit(":"), "path", F.lit(":"), F.col("piece.start_line").cast("string"),
            F.coalesce(twin, F.lit("")),
        ).alias("id"),
        "repo_id", F.col("path").alias("file_path"), "language", "piece.content", "piece.start_line",
        "piece.end_line", "piece.symbol_name", "piece.symbol_type",
        F.concat("path", F.lit("\u0000"), F.lpad(F.col("seq").cast("string"), 9, "0")).alias("ord"),
    )


def module_piece(path: Column, content: Column) -> Column:
    return F.struct(
        basename(path).alias("symbol_name"), F.lit("module").alias("symbol_type"), F.lit(1).alias("start_line"),
        count_lines(content).alias("end_line"), trim_space(content).alias("content"), F.lit(0).alias("twin"),
    )


def markdown_sections(files: DataFrame) -> DataFrame:
    """Chunks of ``files(repo_id, path, content)``, all taken as Markdown."""
    kept = files.where(~is_blank(F.col("content")))
    return _exploded(_with_sections(kept, F.lit(True)), F.col("sections"), F.lit("markdown"))


def file_symbols(files: DataFrame) -> DataFrame:
    """``(repo_id, path, content, symbols)`` for the code files of ``files(repo_id, path, content)``."""
    language, slim = language_of(F.col("path")), files.select("repo_id", "path", "content")
    scripts = [name for name in fv.PARSED_LANGUAGES if name != "python"]
    coded = python_symbols(slim.where(language == "python")).unionByName(script_symbols(slim.where(language.isin(*scripts))))
    # Asked of the result: a filter below would compute a derived text for itself, in both branches and for every file.
    return coded.where(F.col("content").isNotNull())


def symbol_chunks(files: DataFrame) -> DataFrame:
    """Chunks of the functions, classes and methods in code files; files without any give none."""
    return _exploded(file_symbols(files), F.col("symbols"), language_of(F.col("path")))


def module_chunks(files: DataFrame) -> DataFrame:
    kept = files.where(~is_blank(F.col("content")))
    language = F.coalesce(language_of(F.col("path")), F.lit("text"))
    return _exploded(kept, F.array(module_piece(F.col("path"), F.col("content"))), language)


def chunk_files(files: DataFrame) -> DataFrame:
    """Every chunk of every file: Markdown by section, code by symbol, anything else whole."""
    path, content = F.col("path"), F.col("content")
    routed = files.where(~is_blank(content)).select("repo_id", "path", "content", route_of(path).alias("route"))
    is_doc = F.col("route") == "doc"
    language = F.coalesce(language_of(path), F.lit("text"))
    module = F.array(module_piece(path, content))
    plain = _with_sections(routed.where("route <> 'code'"), is_doc)
    coded = file_symbols(routed.where("route = 'code'"))
    return _exploded(plain, F.when(is_doc, F.col("sections")).otherwise(module), F.when(is_doc, "markdown").otherwise(language)).unionByName(
        _exploded(coded, F.when(F.size("symbols") > 0, F.col("symbols")).otherwise(module), language))
