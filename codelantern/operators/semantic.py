"""Exact nearest neighbours by cosine for a batch of query vectors.

Each task multiplies its Arrow batches with the query matrix and passes on
``top_k`` rows per query; the ranking window then trims again before its
shuffle.  What travels is candidates, never query x chunk pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelantern.config import SearchOptions
from codelantern.functions.text import is_blank
from codelantern.functions.vectors import unit_rows
from codelantern.operators import vector_blocks
from codelantern.operators.blocks import ARROW_TYPES, within_reach
from codelantern.operators.sizing import hinted, is_small, only_repos

# Identical vectors must tie whatever the summation order; they do at nine decimals.
SCORE_SCALE = 10**9
MATRIX_CELLS = 4_000_000


def _best_rows(queries: pa.Table, chunks: pa.Table, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The ``k`` best chunks for each query of one repository, ties in store order."""
    chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[("ord", "ascending")])).combine_chunks()
    n = chunks.num_rows
    k = min(k, n)
    place = np.arange(n - 1, -1, -1)
    stored = chunks.column("embedding").combine_chunks()
    step = max(1, MATRIX_CELLS // n)
    lengths = pc.list_value_length(queries.column("vector")).to_numpy()
    for dim in np.unique(lengths):
        same = queries.take(pa.array(np.flatnonzero(lengths == dim)))
        units = unit_rows(stored, int(dim)).T
        for start in range(0, same.num_rows, step):
            block = same.slice(start, step).combine_chunks()
            scores = unit_rows(block.column("vector").combine_chunks(), int(dim)) @ units
            scaled = np.rint(scores * SCORE_SCALE).astype("int64")
            best = np.argpartition(scaled * n + place, n - k, axis=1)[:, n - k:]
            picked = pa.array(best.ravel())
            asked = pa.array(np.repeat(np.arange(block.num_rows), k))
            columns = {
                "query_id": block.column("query_id").take(asked),
                "repo_id": block.column("repo_id").take(asked),
                "id": chunks.column("id").take(picked),
                "ord": chunks.column("ord").take(picked),
                "raw_score": pa.chunked_array([np.take_along_axis(scaled, best, 1).ravel() / SCORE_SCALE]),
            }
            yield from pa.table(columns, schema=schema).combine_chunks().to_batches()


def _candidate_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("repo_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ord", chunks.schema["ord"].dataType),
        T.StructField("raw_score", T.DoubleType()),
    ])


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(field.name, ARROW_TYPES[type(field.dataType)]) for field in schema])


def _slices(rows: pa.Table) -> dict[str, pa.Table]:
    """The rows of each repository, cut out of one sorted copy."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("repo_id", "ascending")]))
    found, start = {}, 0
    for run in pc.run_end_encode(rows["repo_id"]).chunks if rows.num_rows else []:
        base = start
        for repo, end in zip(run.values.to_pylist(), run.run_ends.to_pylist(), strict=True):
            piece = rows.slice(start, base + end - start)
            found[repo] = pa.concat_tables([found[repo], piece]) if repo in found else piece
            start = base + end
    return found


def _scan_with_broadcast(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Measured small batch: every task holds the queries and the chunks are read once, unshuffled."""
    schema = _candidate_schema(queries, chunks)
    arrow = _arrow_schema(schema)
    shared = chunks.sparkSession.sparkContext.broadcast(queries.toArrow())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _slices(shared.value)
        for batch in batches:
            for repo, mine in _slices(pa.Table.from_batches([batch])).items():
                if repo in wanted:
                    yield from _best_rows(wanted[repo], mine, k, arrow)

    return chunks.mapInArrow(search, schema)


def _search_in_blocks(queries: DataFrame, chunks: DataFrame, options: SearchOptions) -> DataFrame:
    """Large batch: tile each repository into (chunk slice, query block) groups of bounded size."""
    chunk_counts = chunks.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    grid = (
        queries.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_queries"))
        .join(chunk_counts, "repo_id")
        .select(
            "repo_id",
            F.ceil(F.col("n_chunks") / options.block_rows).cast("int").alias("slices"),
            F.ceil(F.col("n_queries") / options.block_queries).cast("int").alias("blocks"),
        )
    )
    grid = hinted(grid, is_small(grid, options, F.octet_length("repo_id")))

    def part(key: str, count: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def copies(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = chunks.join(grid, "repo_id").select(
        "repo_id", "id", "ord", "embedding", part("id", "slices").alias("slice"), copies("blocks").alias("block")
    )
    right = queries.join(grid, "repo_id").select(
        "repo_id", "query_id", "vector", part("query_id", "blocks").alias("block"), copies("slices").alias("slice")
    )
    schema = _candidate_schema(queries, chunks)
    arrow = _arrow_schema(schema)
    k = options.top_k

    def tile(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked.num_rows:
            return arrow.empty_table()
        return pa.Table.from_batches(_best_rows(asked, vectors, k, arrow), schema=arrow)

    keys = ["repo_id", "slice", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, schema)


def semantic_search(chunks: DataFrame | vector_blocks.VectorIndex, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Top ``top_k`` chunks per query: ``(query_id, repo_id, id, ord, cosine, score, semantic_rank)``.

    ``queries`` needs ``query_id, repo_id, text, vector``.  A blank question and a
    chunk without an embedding take no part; a vector of another length scores 0.
    Of a stored vector index only the blocks within reach are read.
    """
    asked = queries.where(~is_blank(F.col("text")) & F.col("vector").isNotNull()).select(
        "query_id", "repo_id", "vector"
    )
    index = None if isinstance(chunks, DataFrame) else chunks
    small = is_small(asked, options, 8 * F.size("vector"))
    stored = only_repos(chunks if index is None else index.rows, asked, options).where(F.col("embedding").isNotNull())
    if small and index is not None and index.n_blocks >= options.bounded_from:
        bounds = vector_blocks.cosine_bounds(replace(index, pivots=only_repos(index.pivots, asked, options)), asked)
        # Blocks of other queries come along: a query may meet more rows than it must, never fewer.
        stored = within_reach(stored, bounds, lambda rows: _scan_with_broadcast(
            asked, rows.select("repo_id", "id", "ord", "embedding"), options.top_k), options, 1e-8)
    stored = stored.select("repo_id", "id", "ord", "embedding")
    if small:
        found = _scan_with_broadcast(asked, stored, options.top_k)
    else:
        found = _search_in_blocks(asked, stored, options)
    order = Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), "ord")
    return (
        found.withColumn("semantic_rank", F.row_number().over(order))
        .where(F.col("semantic_rank") <= options.top_k)
        .select(
            "query_id", "repo_id", "id", "ord", F.col("raw_score").alias("cosine"),
            (1.0 / F.col("semantic_rank")).alias("score"), "semantic_rank",
        )
    )
