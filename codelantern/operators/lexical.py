"""Token index and BM25 ranking for a batch of queries.

A document's whole token set lives in one row, so term weights and lengths are
computed where the row is, and a search scores a document where its row is read:
each task keeps ``top_k`` candidates per query and passes only those on.

Stored rows come in blocks with, for each token, the greatest weight and the least
length in the block.  What they give a query bounds every score in the block: a few
promising blocks are scored first, and of the others only those are read whose
bound reaches the last place of the ranking found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelantern import fixed_values as fv
from codelantern.config import SearchOptions
from codelantern.functions.text import tokenize
from codelantern.operators.blocks import ARROW_TYPES, in_parts, within_reach
from codelantern.operators.sizing import durable, hinted, is_small, only_repos


def token_sets(chunks: DataFrame) -> DataFrame:
    """One row per chunk with its distinct tokens; the first ``n_content`` come from the content."""
    fields = chunks.select(
        "repo_id", "id", "ord",
        tokenize(F.col("content")).alias("content_tokens"),
        tokenize(F.col("file_path")).alias("path_tokens"),
        tokenize(F.col("symbol_name")).alias("symbol_tokens"),
    )
    merged = F.array_union("content_tokens", F.array_union("path_tokens", "symbol_tokens"))
    return fields.select(
        "repo_id", "id", "ord", "path_tokens", "symbol_tokens",
        F.size("content_tokens").alias("n_content"), merged.alias("tokens"),
    ).withColumn("dl", F.size("tokens").cast("long"))


def _weight(token: Column, place: Column) -> Column:
    """The summed weights of the fields that hold a token; ``place`` is its index in ``tokens``."""
    return (
        F.when(place < F.col("n_content"), fv.CONTENT_WEIGHT).otherwise(0)
        + F.when(F.array_contains("path_tokens", token), fv.PATH_WEIGHT).otherwise(0)
        + F.when(F.array_contains("symbol_tokens", token), fv.SYMBOL_WEIGHT).otherwise(0)
    )


def token_rows(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``(repo_id, id, ord, tokens, tf, dl)`` by chunk: its tokens beside their weights.

    With ``asked(repo_id, wanted)`` only chunks of those repositories and only wanted
    tokens are kept; a chunk without any stays, as it counts in the statistics.
    """
    sets = token_sets(chunks)
    if asked is None:
        pairs = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), _weight(t, i).alias("tf")))
        rows = sets
    else:
        rows = sets.join(asked, "repo_id")
        pairs = F.transform(
            F.array_intersect("tokens", "wanted"),
            lambda t: F.struct(t.alias("token"), _weight(t, F.array_position("tokens", t) - 1).alias("tf")))
    return rows.select("repo_id", "id", "ord", pairs.alias("pairs"), "dl").select(
        "repo_id", "id", "ord", F.col("pairs.token").alias("tokens"), F.col("pairs.tf").cast("array<int>").alias("tf"), "dl")


def doc_lengths(chunks: DataFrame) -> DataFrame:
    return token_sets(chunks).select("repo_id", "id", "ord", "dl")


def flat_postings(rows: DataFrame) -> DataFrame:
    """Token rows as ``(repo_id, id, ord, token, tf, dl)``."""
    # The outer form keeps the optimizer from adding a size(tokens) > 0 filter
    # below, which would tokenize every text a second time.
    flat = rows.select("repo_id", "id", "ord", "dl", F.explode_outer(F.arrays_zip("tokens", "tf")).alias("p"))
    return flat.where("p is not null").select(
        "repo_id", "id", "ord", F.col("p.tokens").alias("token"), F.col("p.tf").cast("long").alias("tf"), "dl")


def postings(chunks: DataFrame) -> DataFrame:
    """``(repo_id, id, ord, token, tf, dl)``; tf is the sum of the weights of the fields hit."""
    flat = token_sets(chunks).select("*", F.posexplode_outer("tokens").alias("pos", "token")).where(F.col("token").isNotNull())
    return flat.select("repo_id", "id", "ord", "token", _weight(F.col("token"), F.col("pos")).cast("long").alias("tf"), "dl")


def doc_frequencies(chunks: DataFrame) -> DataFrame:
    return postings(chunks).groupBy("repo_id", "token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Documents and mean length per repository; token-less documents count."""
    return _stats(doc_lengths(chunks))


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def _doc_freq(rows: DataFrame) -> DataFrame:
    tokens = rows.select("repo_id", F.explode_outer("tokens").alias("token")).where("token is not null")
    return tokens.groupBy("repo_id", "token").agg(F.count(F.lit(1)).alias("df"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by repository; ids that look like numbers or dates stay strings."""
    fields = [T.StructField("repo_id", T.StringType()) if f.name == "repo_id" else f for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


@dataclass(frozen=True)
class LexicalIndex:
    """Token rows with their statistics: stored tables, or the chunks to derive them from per batch."""

    rows: DataFrame | None
    doc_freq: DataFrame | None
    stats: DataFrame | None
    chunks: DataFrame | None = None
    blocks: DataFrame | None = None     # rows of ``block_summaries``, if the rows are stored in blocks
    n_blocks: float = 0
    derived: bool = False               # the statistics are computed from the rows, by each search for its own tokens
    all_rows: DataFrame | None = None   # stored rows with those that later ones hide, and what leaves these out
    shown: Callable[[DataFrame], DataFrame] | None = None
    thin: bool = False                  # the rows have the wanted tokens only

    @classmethod
    def over(cls, chunks: DataFrame) -> LexicalIndex:
        """No stored index: each batch reads the texts once and keeps only the tokens it asks for."""
        return cls(None, None, None, chunks)

    @classmethod
    def of(cls, chunks: DataFrame) -> LexicalIndex:
        """Tokenize ``chunks`` once for several searches; the tables live as long as the application."""
        rows = durable(token_rows(chunks))
        return cls(rows, _doc_freq(rows), _stats(rows), derived=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*(_read(spark, f"{path}/{name}") for name in ("rows", "doc_freq", "stats")))

    @classmethod
    def save(cls, chunks: DataFrame, path: str) -> None:
        """Write the index of the repositories in ``chunks``, each to its own partition of three tables.

        Only the given repositories are replaced.  A partition holds its chunks in
        store order; rebalancing splits a repository that dwarfs the others.
        """
        spark = chunks.sparkSession

        def write(rows: DataFrame, name: str, *order: str) -> None:
            (
                rows.hint("rebalance", F.col("repo_id")).sortWithinPartitions("repo_id", *order).write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{path}/{name}")
            )

        repos = chunks.select("repo_id").distinct()
        write(token_rows(chunks), "rows", "ord")
        stored = _read(spark, f"{path}/rows").join(repos, "repo_id", "left_semi")
        write(_doc_freq(stored), "doc_freq", "token")
        write(_stats(stored), "stats")

    def narrowed(self, queries: DataFrame, options: SearchOptions) -> LexicalIndex:
        """The index with the repositories of a batch pushed into its scans."""
        if self.chunks is not None:
            return LexicalIndex.over(only_repos(self.chunks, queries, options))
        narrow = [only_repos(t, queries, options) for t in (self.rows, self.doc_freq, self.stats)]
        blocks, raw = (t and only_repos(t, queries, options) for t in (self.blocks, self.all_rows))
        return LexicalIndex(*narrow, None, blocks, self.n_blocks, self.derived, raw, self.shown)

    def thinned(self, terms: pa.Table) -> LexicalIndex:
        """The index with the wanted tokens of each row only, cut down before hidden rows are joined away: few tokens of a row are moved."""
        if self.all_rows is None:
            return self
        return replace(self, rows=self.shown(wanted_tokens(self.all_rows, terms)), thin=True)

    def for_terms(self, terms: DataFrame, small: bool) -> LexicalIndex:
        """The part of the index that a batch of query terms can touch."""
        if self.chunks is None and not (self.derived and small):
            return self
        asked = hinted(terms.groupBy("repo_id").agg(F.collect_set("token").alias("wanted")), small)
        rows = durable(token_rows(self.chunks, asked) if self.chunks is not None else _with_wanted(self.rows, asked))
        return LexicalIndex(rows, _doc_freq(rows), _stats(rows))

    def for_batches(self, *batches: DataFrame, options: SearchOptions = SearchOptions()) -> LexicalIndex:
        """The part of the index that several batches ``(query_id, repo_id, text)`` can touch, made once for all of them."""
        queries = reduce(DataFrame.unionByName, (b.select("query_id", "repo_id", "text") for b in batches))
        return self.narrowed(queries, options).for_terms(query_tokens(queries), is_small(queries, options, F.octet_length("text")))


def query_tokens(queries: DataFrame) -> DataFrame:
    """``(query_id, repo_id, token, pos)``; a blank query has no tokens and so no rows."""
    return queries.select(
        "query_id", "repo_id", F.posexplode_outer(tokenize(F.col("text"))).alias("pos", "token")
    ).where(F.col("token").isNotNull())


def weighted_terms(index: LexicalIndex, terms: DataFrame, small: bool) -> DataFrame:
    """Query terms with their inverse document frequency; unknown terms drop out."""
    # Restricted to the repositories asked about, the statistics are no larger than the batch.
    stats = index.stats.join(hinted(terms.select("repo_id").distinct(), small), "repo_id", "left_semi")
    known = index.doc_freq.join(hinted(terms, small), ["repo_id", "token"]).join(hinted(stats, small), "repo_id")
    n, df = F.col("n_docs"), F.col("df")
    return known.select(
        "query_id", "repo_id", "token", "pos", "avg_dl", F.log((n - df + 0.5) / (df + 0.5) + 1.0).alias("idf")
    )


def _term_scores(idf, tf, dl, mean):
    """BM25 of one term, for columns and arrays alike."""
    norm = 1.0 - fv.BM25_B + fv.BM25_B * (dl / mean)
    return idf * ((tf * (fv.BM25_K1 + 1.0)) / (tf + fv.BM25_K1 * norm))


class _BatchScorer:
    """The terms of all queries by repository and token, laid out for array look-ups."""

    def __init__(self, terms: pa.Table):
        terms = terms.sort_by([("repo_id", "ascending"), ("token", "ascending")]).combine_chunks()
        keys = pc.binary_join_element_wise(terms["repo_id"], terms["token"], "\0").combine_chunks()
        distinct = pc.unique(keys)
        self.keys = distinct
        code = pc.index_in(keys, distinct).to_numpy(zero_copy_only=False)
        self.first = np.searchsorted(code, np.arange(len(distinct)))
        self.count = np.bincount(code, minlength=len(distinct)) if len(code) else np.zeros(0, int)
        self.repos = set(terms["repo_id"].unique().to_pylist())
        self.query_ids = pc.unique(terms["query_id"].combine_chunks())
        self.query = pc.index_in(terms["query_id"], self.query_ids).to_numpy(zero_copy_only=False).astype(np.int64) if len(code) else np.zeros(0, np.int64)
        self.idf = terms["idf"].to_numpy()
        self.pos = terms["pos"].to_numpy().astype(np.int64)
        mean = terms["avg_dl"].to_numpy()
        self.mean = np.where(mean > 0, mean, 1.0)

    def _sums(self, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Pairs of a query and a row with a token in common, their scores and the first such place in the query.

        ``dl`` is one length per row, or one per token.
        """
        tokens, tf = rows.column("tokens"), rows.column("tf")
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(rows.num_rows), sizes)
        keys = pc.binary_join_element_wise(rows.column("repo_id").take(pa.array(row)), tokens.flatten(), "\0")
        code = pc.fill_null(pc.index_in(keys, self.keys), -1).to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(code >= 0)
        if not len(hit):
            return None
        code, row = code[hit], row[hit]
        weight = tf.flatten().to_numpy(zero_copy_only=False)[hit].astype(float)
        dl = rows.column("dl")
        dl = dl.to_numpy(zero_copy_only=False)[row] if pa.types.is_integer(dl.type) else dl.flatten().to_numpy(zero_copy_only=False)[hit]
        many = self.count[code]
        ends = np.cumsum(many)
        term = np.repeat(self.first[code] - (ends - many), many) + np.arange(ends[-1])
        row, weight, dl = np.repeat(row, many), np.repeat(weight, many), np.repeat(dl.astype(float), many)
        score = _term_scores(self.idf[term], weight, dl, self.mean[term])
        pair, at = np.unique(self.query[term] * rows.num_rows + row, return_inverse=True)
        total = np.bincount(at, score)
        first = np.full(len(pair), np.iinfo(np.int64).max)
        np.minimum.at(first, at, self.pos[term])
        return pair, total, first

    def best(self, rows: pa.RecordBatch, k: int, schema: pa.Schema) -> pa.RecordBatch | None:
        """The ``k`` best rows of the batch for each query, equal scores by first matching token, then store order."""
        sums = self._sums(rows)
        if sums is None:
            return None
        pair, total, first = sums
        query, row = pair // rows.num_rows, pair % rows.num_rows
        place = np.empty(rows.num_rows, np.int64)
        place[pc.sort_indices(rows.column("ord")).to_numpy()] = np.arange(rows.num_rows)
        order = np.lexsort((place[row], first, -np.round(total, 9), query))
        query = query[order]
        start = np.searchsorted(query, query)
        order = order[np.arange(len(order)) - start < k]
        picked = pa.array(row[order])
        return pa.RecordBatch.from_arrays([
            self.query_ids.take(pa.array(pair[order] // rows.num_rows)), rows.column("repo_id").take(picked),
            rows.column("id").take(picked), rows.column("ord").take(picked), pa.array(total[order]),
            pa.array(first[order].astype(np.int32)),
        ], schema=schema)


def _block_keys(rows: pa.RecordBatch) -> np.ndarray:
    """A number per row, the same for neighbours of one block."""
    keys = pc.binary_join_element_wise(rows.column("repo_id"), rows.column("block").cast(pa.string()), "\0")
    return np.cumsum(np.append([True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))) - 1


def _block_heads(rows: pa.RecordBatch) -> np.ndarray:
    """Where blocks begin."""
    group = _block_keys(rows)
    return np.searchsorted(group, np.arange(group[-1] + 1))


def _summaries(batch: pa.RecordBatch) -> pa.RecordBatch:
    group, heads = _block_keys(batch), _block_heads(batch)
    sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
    named = batch.column("tokens").flatten().dictionary_encode()
    # In alphabetical order neighbours share their beginnings, which compresses well.
    order = pc.sort_indices(named.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy(zero_copy_only=False)] = np.arange(len(order))
    named = pa.DictionaryArray.from_arrays(pa.array(rank[named.indices.to_numpy(zero_copy_only=False)]), named.dictionary.take(order))
    code = np.repeat(group, sizes) * (len(named.dictionary) + 1) + named.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.append([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    tf = np.maximum.reduceat(batch.column("tf").flatten().to_numpy(zero_copy_only=False)[order], starts) if len(code) else code
    dl = np.repeat(batch.column("dl").to_numpy(zero_copy_only=False), sizes)[order]
    dl = np.minimum.reduceat(dl, starts) if len(code) else code
    found = code[starts]
    ends = np.searchsorted(found // (len(named.dictionary) + 1), np.arange(len(heads) + 1))
    offsets = pa.array(ends.astype(np.int32))
    token = named.dictionary.take(pa.array(found % (len(named.dictionary) + 1)))
    return pa.RecordBatch.from_arrays([
        batch.column("repo_id").take(pa.array(heads)), batch.column("block").take(pa.array(heads)),
        *(pa.ListArray.from_arrays(offsets, v) for v in (token, pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int64))))],
        names=["repo_id", "block", "tokens", "tf", "dl"])


def summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summaries of each batch, made a few blocks at a time."""
    for batch in batches:
        for part in in_parts(batch, "tokens", _block_heads(batch)) if batch.num_rows else []:
            yield _summaries(part)


def block_summaries(rows: DataFrame) -> DataFrame:
    """``(repo_id, block, tokens, tf, dl)``: of the rows of a block, the greatest weight and least length by token.

    ``rows(repo_id, block, tokens, tf, dl)`` are summed where they are read; a block that several tasks read has
    a summary of each part, which bounds the rows of that part.
    """
    return rows.select("repo_id", "block", "tokens", "tf", "dl").mapInArrow(
        summarized, "repo_id string, block long, tokens array<string>, tf array<int>, dl array<long>")


def _with_wanted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the asked repositories with ``tokens`` and the lists beside them cut down to ``wanted``."""
    shared = rows.join(asked, "repo_id").withColumn("shared", F.array_intersect("tokens", "wanted"))
    placed = shared.withColumn("at", F.transform("shared", lambda t: F.array_position("tokens", t).cast("int")))

    def picked(name: str) -> Column:
        return F.transform("at", lambda i: F.element_at(name, i)).alias(name)

    lists = {f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType)} - {"tokens"}
    return placed.select(*(F.col("shared").alias(c) if c == "tokens" else picked(c) if c in lists else c for c in rows.columns))


def wanted_tokens(rows: DataFrame, terms: pa.Table) -> DataFrame:
    """Token rows with only the tokens that some query asks of their repository; rows without any drop out.

    Most tokens of a text are in no query: they would only pass through the Python workers.
    """
    asked = terms.select(["repo_id", "token"]).group_by("repo_id").aggregate([("token", "distinct")]).rename_columns({"token_distinct": "wanted"})
    wanted = rows.sparkSession.createDataFrame(asked.to_pylist(), "repo_id string, wanted array<string>")
    return _with_wanted(rows, F.broadcast(wanted)).where(F.size("tokens") > 0)


def block_bounds(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """``(query_id, repo_id, seq, block, bound)`` for blocks that share a token with a query, a row for each part of a block.

    A summary has tens of thousands of tokens, so they meet the few terms in a join, not list against list.
    """
    rows = index.blocks.withColumn("part", F.monotonically_increasing_id())
    flat = rows.select("repo_id", "seq", "block", "part", F.explode_outer(F.arrays_zip("tokens", "tf", "dl")).alias("p"))
    asked = terms.select("query_id", "repo_id", "token", "idf", F.when(F.col("avg_dl") > 0, F.col("avg_dl")).otherwise(1.0).alias("mean"))
    hits = flat.select("repo_id", "seq", "block", "part", F.col("p.tokens").alias("token"), "p.tf", "p.dl").join(F.broadcast(asked), ["repo_id", "token"])
    bound = F.sum(_term_scores(F.col("idf"), F.col("tf"), F.col("dl"), F.col("mean"))).alias("bound")
    return hits.groupBy("query_id", "repo_id", "seq", "block", "part").agg(bound).drop("part")


def within_terms(index: LexicalIndex, terms: DataFrame, options: SearchOptions) -> LexicalIndex:
    """The index without the blocks that cannot reach a query's last place."""
    # Scores are compared at nine decimals.
    rows = within_reach(
        index.rows, block_bounds(index, terms), lambda rows: _scored_in_place(replace(index, rows=rows), terms, options.top_k), options, 1e-8)
    return replace(index, rows=rows)


def _scored_in_place(index: LexicalIndex, terms: DataFrame, k: int) -> DataFrame:
    """Measured small batch: every task holds the terms, and a chunk is scored where its row is read."""
    rows = index.rows.select("repo_id", "id", "ord", "tokens", "tf", "dl")
    schema = T.StructType([
        T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField("repo_id", T.StringType()),
        T.StructField("id", T.StringType()), T.StructField("ord", rows.schema["ord"].dataType),
        T.StructField("raw_score", T.DoubleType()), T.StructField("first_pos", T.IntegerType()),
    ])
    arrow = pa.schema([(f.name, ARROW_TYPES[type(f.dataType)]) for f in schema])
    table = terms.toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _BatchScorer(shared.value)
        for batch in batches:
            for part in in_parts(batch, "tokens"):
                found = scorer.best(part, k, arrow) if len(scorer.keys) else None
                if found is not None:
                    yield found

    return (rows if index.thin else wanted_tokens(rows, table)).mapInArrow(score, schema)


def _scored_by_shuffle(index: LexicalIndex, terms: DataFrame, options: SearchOptions) -> DataFrame:
    """Large batch: postings meet terms in a join, and partial sums per (query, chunk) travel.

    One common token may own a third of all postings, so its key is split by
    document and the terms are copied per salt.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(options.salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(options.salts - 1)))
    hits = flat_postings(index.rows).withColumn("salt", salt).join(
        terms.withColumn("salt", copies), ["repo_id", "token", "salt"])
    mean = F.when(F.col("avg_dl") > 0, F.col("avg_dl")).otherwise(1.0)
    return hits.groupBy("query_id", "repo_id", "id", "ord").agg(
        F.sum(_term_scores(F.col("idf"), F.col("tf"), F.col("dl"), mean)).alias("raw_score"), F.min("pos").alias("first_pos")
    )


def bm25_search(index: LexicalIndex, queries: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Top ``top_k`` chunks per query: ``(query_id, repo_id, id, ord, score, bm25_rank)``.

    Nine decimals absorb the order of floating-point summation; equal scores go
    to the earliest matching query token, then to store order.
    """
    small = is_small(queries, options, F.octet_length("text"))
    terms = query_tokens(queries)
    index = index.narrowed(queries, options).for_terms(terms, small)
    weighted = weighted_terms(index, terms, small)
    if small and index.blocks is not None and index.n_blocks >= options.bounded_from:
        weighted = durable(weighted)
        index = within_terms(index.thinned(weighted.toArrow()), weighted, options)
    scored = _scored_in_place(index, weighted, options.top_k) if small else _scored_by_shuffle(index, weighted, options)
    order = Window.partitionBy("query_id").orderBy(
        F.round("raw_score", 9).desc(), "first_pos", "ord"
    )
    return (
        scored.withColumn("bm25_rank", F.row_number().over(order))
        .where(F.col("bm25_rank") <= options.top_k)
        .select("query_id", "repo_id", "id", "ord", F.round("raw_score", 4).alias("score"), "bm25_rank")
    )
