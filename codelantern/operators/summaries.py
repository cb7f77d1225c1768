"""Counts and roll-ups over files and chunks.  All combine map-side before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.functions.text import count_lines, percent_of


def corpus_size(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.sum("size_bytes").alias("total_bytes"))


def repo_size_guard(files: DataFrame, max_bytes: int = fv.MAX_REPO_SIZE_BYTES) -> DataFrame:
    return corpus_size(files).withColumn("over_cap", F.col("total_bytes") > max_bytes)


def repo_count(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


def _kind_counts() -> list[Column]:
    plural = {"function": "functions", "class": "classes", "method": "methods", "module": "modules", "doc": "docs"}
    return [F.count_if(F.col("symbol_type") == kind).alias(plural[kind]) for kind in fv.SYMBOL_TYPES]


def _language_set() -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("languages")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """Per repository: the number of chunks of each of the five kinds."""
    return chunks.groupBy("repo_id").agg(*_kind_counts())


def chunk_percentages(chunks: DataFrame) -> DataFrame:
    return (
        chunks.groupBy("repo_id").agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("symbol_type") == kind).alias(kind) for kind in fv.SYMBOL_TYPES],
        )
        .select("repo_id", *[percent_of(F.col(k), F.col("total")).alias(f"{k}_pct") for k in fv.SYMBOL_TYPES])
    )


def languages(chunks: DataFrame) -> DataFrame:
    """Distinct languages per repository, sorted; unknown ones are left out."""
    return chunks.groupBy("repo_id").agg(_language_set())


def chunk_coverage(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lines of ``files(repo_id, path, content)`` in chunks, in several at once, and in none: per file, and per repository (null path).

    A sweep over the starts and ends of a file's chunks gives the stretches with one chunk or
    more, so nested and adjoining chunks count each line once.
    """
    key = ["repo_id", "file_path"]
    ends = F.array(
        F.struct(F.col("start_line").alias("at"), F.lit(1).alias("change")), F.struct((F.col("end_line") + 1).alias("at"), F.lit(-1).alias("change")))
    marks = chunks.select(*key, F.explode_outer(ends).alias("end")).groupBy(*key, "end.at").agg(F.sum("end.change").alias("change"))
    in_order = Window.partitionBy(*key).orderBy("at")
    depth = F.sum("change").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    stretches = marks.select(*key, depth.alias("depth"), (F.lead("at").over(in_order) - F.col("at")).alias("n"))
    covered = stretches.groupBy(*key).agg(
        F.sum(F.when(F.col("depth") > 0, F.col("n"))).alias("covered"), F.sum(F.when(F.col("depth") > 1, F.col("n"))).alias("overlapping"))
    lines = files.select("repo_id", F.col("path").alias("file_path"), F.coalesce(count_lines(F.col("content")), F.lit(0)).alias("n_lines"))
    none = F.lit(0).cast("long")
    whole = lines.join(covered, key, "left").select(
        *key, "n_lines", F.coalesce("covered", none).alias("covered"), F.coalesce("overlapping", none).alias("overlapping"))
    return whole.groupingSets([[F.col("repo_id"), F.col("file_path")], [F.col("repo_id")]], "repo_id", "file_path").agg(
        F.sum("n_lines").alias("n_lines"), F.sum("covered").alias("covered"), F.sum("overlapping").alias("overlapping"),
        F.sum(F.col("n_lines") - F.col("covered")).alias("dropped"))


def file_inventory(chunks: DataFrame) -> DataFrame:
    """Distinct file paths per repository, in path order inside every repository.

    Rows are dealt by both columns, so a large repository is many tasks; each task's rows are sorted.
    """
    return chunks.select("repo_id", "file_path").distinct().sortWithinPartitions("repo_id", "file_path")


def capped_inventory(chunks: DataFrame, limit: int = fv.MAX_INVENTORY_FILES) -> DataFrame:
    """The first ``limit`` paths per repository with their position and the full count.

    The cap is the feature: a prompt lists so many files.  Each task trims to
    ``limit`` rows per repository before the window's shuffle.
    """
    paths = chunks.select("repo_id", "file_path").distinct()
    order = Window.partitionBy("repo_id").orderBy("file_path")
    first = paths.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    totals = paths.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    return first.join(totals, "repo_id")


def ingest_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per repository: file and chunk counts, languages and chunks by kind."""
    n_files = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("file_count"))
    # One aggregation: the chunks are made once.
    counted = chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("chunk_count"), _language_set(), *_kind_counts())
    return n_files.join(counted, "repo_id")


def health_rollup(checks: DataFrame) -> DataFrame:
    """``(group_id, ok)`` rows to one status per group."""
    return checks.groupBy("group_id").agg(
        F.when(F.bool_and("ok"), "healthy").when(F.bool_or("ok"), "degraded").otherwise("unhealthy").alias("status")
    )


def conversation_log(messages: DataFrame) -> DataFrame:
    """Messages in conversation order with their position and whether the user wrote them."""
    return messages.select(
        "conv_id", "turn", "role", "text", (F.col("role") == "user").alias("is_user")
    ).orderBy("conv_id", "turn")
