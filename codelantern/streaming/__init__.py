"""Continuous ingestion.

Chunking and embedding are narrow (one file is one row, nothing is grouped), so
they are the same for a micro-batch as for a whole repository.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from codelantern.config import FilterConfig
from codelantern.operators.chunking import chunk_files
from codelantern.operators.embedding import Embedder, HashingEmbedder, embed_chunks
from codelantern.operators.filtering import select_files
from codelantern.operators.sizing import durable, scratch
from codelantern.sources.store import ChunkStore


def ingest_stream(
    files: DataFrame, store: ChunkStore, embedder: Embedder | None = None, config: FilterConfig = FilterConfig()
) -> DataStreamWriter:
    """Feed the store from a stream of ``files(repo_id, path, size_bytes, content)``.

    A file that comes again replaces all its chunks, and one that is no longer
    eligible or is blank loses them, so a replayed micro-batch leaves the same rows.  Of a file that
    comes twice in one micro-batch any one version is taken.  The caller sets trigger and checkpoint
    location and starts the query.
    """
    embedder = embedder or HashingEmbedder()

    def feed(batch: DataFrame, _: int) -> None:
        latest = batch.dropDuplicates(["repo_id", "path"])
        with scratch(batch.sparkSession):
            stored = durable(latest)
            store.replace_files(stored, embed_chunks(chunk_files(select_files(stored, config)), embedder))

    return files.writeStream.foreachBatch(feed)
