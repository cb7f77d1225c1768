"""Ingestion of repository trees into the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.config import FilterConfig
from codelantern.operators.chunking import chunk_files
from codelantern.operators.embedding import Embedder, HashingEmbedder, embed_chunks
from codelantern.operators.filtering import select_files
from codelantern.operators.sizing import durable
from codelantern.operators.summaries import ingest_summary, repo_size_guard
from codelantern.sources.listing import list_files, read_files
from codelantern.sources.store import ChunkStore


INGESTED, TOO_LARGE, NO_FILES, NO_CHUNKS = "ingested", "too_large", "no_files", "no_chunks"


def ingest_repositories(
    repos: DataFrame,
    store: ChunkStore,
    embedder: Embedder | None = None,
    config: FilterConfig = FilterConfig(),
    max_repo_bytes: int = fv.MAX_REPO_SIZE_BYTES,
) -> DataFrame:
    """``repos(repo_id, root)`` into the store: one row per repository with ``status``, ``error`` and its summary.

    A repository that is too large, or has no eligible file, is left as it was; one
    whose files give no chunk loses its old rows.  Either way the others are
    ingested.  Summaries come from the new chunks, which are complete before any old row goes.
    """
    # One walk over the trees: the size guard counts every file, the rest prunes the stored listing.
    listing = durable(list_files(repos))
    sizes = durable(repo_size_guard(listing, max_repo_bytes))
    fitting = listing.join(sizes.where("over_cap").select("repo_id"), "repo_id", "left_anti")
    selected = durable(select_files(fitting, config))
    chunks = durable(embed_chunks(chunk_files(durable(read_files(selected))), embedder or HashingEmbedder()))
    summary = durable(ingest_summary(selected, chunks))
    files = selected.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"))
    rows = repos.select("repo_id").distinct().join(sizes, "repo_id", "left").join(files, "repo_id", "left").join(summary, "repo_id", "left")
    status = (
        F.when(F.col("over_cap"), TOO_LARGE).when(F.col("n_files").isNull(), NO_FILES)
        .when(F.col("chunk_count").isNull(), NO_CHUNKS).otherwise(INGESTED)
    )
    error = (
        F.when(F.col("status") == TOO_LARGE, F.format_string(f"%s has %d bytes, more than the {max_repo_bytes} allowed", "repo_id", "total_bytes"))
        .when(F.col("status") == NO_FILES, F.format_string("no eligible file in %s", "repo_id"))
        .when(F.col("status") == NO_CHUNKS, F.format_string("no chunk in the files of %s", "repo_id"))
    )
    found = durable(rows.withColumn("status", status).select(
        "repo_id", "status", error.alias("error"), F.coalesce("n_files", F.lit(0)).alias("file_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "languages", "functions", "classes", "methods", "modules", "docs",
        F.current_timestamp().alias("finished_at")))
    if not chunks.isEmpty():
        store.replace(chunks)
    for row in found.where(F.col("status") == NO_CHUNKS).select("repo_id").toLocalIterator():
        store.clear(row.repo_id)
    return found


def ingest_as_json(summary: DataFrame) -> DataFrame:
    """One response envelope per repository: ``(repo_id, body)``."""
    kinds = F.struct("functions", "classes", "methods", "modules", "docs")
    result = F.struct(
        F.col("repo_id").alias("repoId"), F.col("file_count").alias("fileCount"), F.col("chunk_count").alias("chunkCount"),
        "languages", kinds.alias("chunkSummary"))
    done = F.col("status") == INGESTED
    body = F.struct(done.alias("success"), F.when(done, result).alias("result"), F.col("error"))
    return summary.select("repo_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
