"""Symbols an answer mentions, those not retrieved, and the lookup that follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.config import SearchOptions
from codelantern.functions.text import SPACE_CLASS, is_blank
from codelantern.operators.lexical import LexicalIndex, bm25_search
from codelantern.operators.sizing import durable, hinted, is_small, only_repos, row_bytes

# An ASCII word boundary, then the name: a letter or underscore starts a word, a
# dollar sign is no word character and so needs one before it.  (Java's own \b
# knows accented letters.)  Possessive, as a shorter name can never match either.
_WORD = "[A-Za-z0-9_]"
_REFERENCE = (
    rf"((?:(?<!{_WORD})[a-zA-Z_]|(?<={_WORD})\$)[a-zA-Z0-9_$]{{3,}}+)[{SPACE_CLASS}]*+(?:\(\)|:)"
)


def symbol_references(answers: DataFrame) -> DataFrame:
    """``(answer_id, symbol, ord)``: distinct ``name()`` / ``name:`` mentions, stop words left out."""
    names = F.regexp_extract_all("text", F.lit(_REFERENCE), F.lit(1))
    return (
        answers.select("answer_id", F.posexplode_outer(names).alias("pos", "symbol"))
        .where(F.col("symbol").isNotNull() & ~F.lower("symbol").isin(*fv.SYMBOL_STOP_WORDS))
        .groupBy("answer_id", "symbol").agg(F.min("pos").alias("ord"))
    )


def known_symbols(hits: DataFrame) -> DataFrame:
    """``(answer_id, symbol)``: lower-cased symbol names and path words of the retrieved chunks."""
    words = F.filter(F.split("file_path", "[^a-zA-Z0-9_$]+"), lambda w: F.length(w) > 2)
    named = F.when(F.length("symbol_name") > 0, F.array("symbol_name")).otherwise(F.array().cast("array<string>"))
    return hits.select(
        "answer_id", F.explode(F.concat(words, named)).alias("symbol")
    ).select("answer_id", F.lower("symbol").alias("symbol")).distinct()


def unretrieved_references(answers: DataFrame, hits: DataFrame) -> DataFrame:
    known = known_symbols(hits).withColumnRenamed("symbol", "known")
    refs = symbol_references(answers)
    return refs.join(
        known, (refs["answer_id"] == known["answer_id"]) & (F.lower(refs["symbol"]) == known["known"]), "left_anti"
    )


def first_unretrieved(references: DataFrame) -> DataFrame:
    """The earliest missing symbol of each answer."""
    return references.groupBy("answer_id").agg(F.min_by("symbol", "ord").alias("symbol"))


def reference_lookup(
    index: LexicalIndex,
    chunks: DataFrame,
    references: DataFrame,
    top_k: int = fv.REFERENCE_TOP_K,
    options: SearchOptions = SearchOptions(),
) -> DataFrame:
    """Chunks for ``(query_id, repo_id, symbol)``: ``(query_id, repo_id, id, score, bm25_rank, position)``.

    BM25 hits whose symbol equals, or whose path contains, the reference are
    taken; a reference without any such hit falls back to the first stored
    chunks of its whole repository whose symbol or path contains it.
    """
    asked = references.where(~is_blank(F.col("symbol")))
    located = only_repos(chunks, asked, options).select("repo_id", "id", "ord", "file_path", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"))
    wanted, path, name = F.lower("symbol"), F.lower("file_path"), F.lower("symbol_name")

    limited = SearchOptions(**{**options.__dict__, "top_k": top_k})
    hits = bm25_search(index, asked.withColumn("text", F.col("symbol")), limited)
    hits = durable(hits)
    small = is_small(asked, options, row_bytes(asked)) and is_small(hits, options, row_bytes(hits))
    exact = (
        hinted(hits.drop("ord").join(asked.select("query_id", "symbol"), "query_id"), small)
        .join(located, ["repo_id", "id"])
        .where((name == wanted) | path.contains(wanted))
        .select("query_id", "repo_id", "id", "score", "bm25_rank", F.col("bm25_rank").alias("position"))
    )
    unmet = asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    # Every chunk of the repository is looked at where it is; tasks trim to top_k before the shuffle.
    store_order = Window.partitionBy("query_id").orderBy("ord")
    fallback = (
        hinted(unmet, small).join(located, "repo_id").where(name.contains(wanted) | path.contains(wanted))
        .withColumn("position", F.row_number().over(store_order))
        .where(F.col("position") <= top_k)
        .select(
            "query_id", "repo_id", "id", (1.0 / F.col("position")).alias("score"),
            F.lit(None).cast("int").alias("bm25_rank"), "position",
        )
    )
    return exact.unionByName(fallback)


#: What an added hit brings for the columns of a ranked one.
_CARRIED = {"rrf_score": "score", "source": "'bm25'", "semantic_rank": "cast(null as int)", "bm25_rank": "bm25_rank"}


def append_hits(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """``hits(query_id, id, rank)`` followed by the rows of ``extra(query_id, id, position)`` not yet in it.

    Where the hits have a score, a source and ranks, the added rows bring theirs.
    """
    sizes = hits.groupBy("query_id").agg(F.max("rank").alias("n"))
    carried = [c for c in _CARRIED if c in hits.columns]
    fresh = extra.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("position")
    placed = fresh.join(sizes, "query_id", "left").select(
        "query_id", "id", (F.coalesce("n", F.lit(0)) + F.row_number().over(order)).alias("rank"),
        *(F.expr(_CARRIED[c]).alias(c) for c in carried),
    )
    return hits.select("query_id", "id", "rank", *carried).unionByName(placed)
