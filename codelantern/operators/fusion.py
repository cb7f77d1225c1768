"""Reciprocal-rank fusion of the two rankings and the confidence signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.config import SearchOptions


def fuse(semantic: DataFrame, lexical: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """All merged candidates with ``rrf_score``, ``source`` and their final ``rank``.

    Union plus one aggregation does the work of a full outer join.  A query has
    at most ``2 * top_k`` candidates, which bounds the ranking window.
    """
    keys = ["query_id", "repo_id", "id"]
    both = semantic.select(*keys, "semantic_rank", F.lit(None).cast("int").alias("bm25_rank")).unionByName(
        lexical.select(*keys, F.lit(None).cast("int").alias("semantic_rank"), "bm25_rank")
    )
    merged = both.groupBy(*keys).agg(
        F.max("semantic_rank").alias("semantic_rank"), F.max("bm25_rank").alias("bm25_rank")
    )
    sem, bm = F.col("semantic_rank"), F.col("bm25_rank")
    part = [F.coalesce(1.0 / (options.rrf_k + rank), F.lit(0.0)) for rank in (sem, bm)]
    order = Window.partitionBy("query_id").orderBy(
        F.col("rrf_score").desc(), sem.asc_nulls_last(), bm.asc_nulls_last()
    )
    source = (
        F.when(sem.isNotNull() & bm.isNotNull(), "hybrid").when(bm.isNotNull(), "bm25").otherwise("semantic")
    )
    return (
        merged.withColumn("rrf_score", F.round(part[0] + part[1], 5))
        .withColumn("source", source)
        .withColumn("rank", F.row_number().over(order))
    )


def top_hits(fused: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    return fused.where(F.col("rank") <= options.top_n)


def confidence(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per query: ``(query_id, score, low_confidence, reason)``.

    ``hits`` are the ranked results; ``chunks`` supplies the location of the best one.
    """
    first = hits.where(F.col("rank") <= 2).groupBy("query_id").agg(
        *[F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in ("repo_id", "id", "rrf_score", "source")],
        F.max(F.when(F.col("rank") == 2, F.col("rrf_score"))).alias("runner_up"),
    )
    located = first.join(chunks.select("repo_id", "id", "file_path", "start_line"), ["repo_id", "id"], "left")
    top, gap = F.col("rrf_score"), F.col("rrf_score") - F.coalesce("runner_up", F.lit(0.0))
    weak, hybrid = top < fv.MIN_RRF_SCORE, F.col("source") == "hybrid"

    def scaled(factor: int):
        return F.round(F.least(F.lit(1.0), top * factor), 4)

    score = (
        F.when(top.isNull(), 0.0)
        .when(weak, F.round(top, 4))
        .when(hybrid, scaled(fv.HYBRID_CONFIDENCE_FACTOR))
        .otherwise(scaled(fv.SINGLE_CONFIDENCE_FACTOR))
    )
    reason = (
        F.when(top.isNull(), fv.REASON_NO_CHUNKS)
        .when(weak, F.format_string(fv.REASON_WEAK, top))
        .when(hybrid, F.format_string(fv.REASON_HYBRID, F.col("file_path"), F.col("start_line")))
        .when(gap > fv.DOMINANT_GAP, F.format_string(fv.REASON_DOMINANT, F.col("source")))
        .otherwise(F.format_string(fv.REASON_SINGLE, F.col("source")))
    )
    return queries.select("query_id").join(located, "query_id", "left").select(
        "query_id", score.alias("score"), (top.isNull() | weak).alias("low_confidence"), reason.alias("reason")
    )


def retrieval_stats(queries: DataFrame, fused: DataFrame) -> DataFrame:
    counts = fused.groupBy("query_id").agg(
        F.count("semantic_rank").alias("semantic_candidates"),
        F.count("bm25_rank").alias("bm25_candidates"),
        F.count(F.lit(1)).alias("merged"),
    )
    return queries.select("query_id").join(counts, "query_id", "left").na.fill(0)
