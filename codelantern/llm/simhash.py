"""Near-duplicate documents: SimHash over word shingles, compared exactly in tiles.

Distinct fingerprints are cut into blocks that follow their population counts,
and every pair of blocks whose counts can be within the radius goes to one
task.  The task compares tile by tile with an exclusive-or and a bit count,
leaves out tile pairs whose counts are too far apart, and returns a spanning
star for each group it finds, never the group's pairs.

Block pairs grow with the square of the distinct fingerprints: that is the
price of an exact comparison.  The block size follows the table (``blocks``
blocks up to ``max_block`` fingerprints each), so each fingerprint is sent a
constant number of times until blocks reach that bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern.llm.components import components, spanning_stars
from codelantern.llm.frames import map_slices
from codelantern.operators.sizing import durable

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = b" \t\n\x0b\x0c\r"
#: Row b holds the eight bits of byte b, high bit first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.intp) * 256


@dataclass(frozen=True)
class SimHash:
    words: int = 4          #: words of a shingle
    bits: int = 64          #: of a fingerprint, a multiple of 64
    radius: int = 4         #: differing bits at which two fingerprints still link
    distinct: bool = False  #: count each different shingle of a text once, however often it occurs
    blocks: int = 24        #: blocks that the distinct fingerprints are cut into
    max_block: int = 1 << 20  #: fingerprints of a block at most; larger tables get more blocks

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.bits // 64)]


def _chunks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of ``data`` in lists that cover about ``size`` bytes each."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[at:end].split()
        at = end


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits of a shingle's wider hash, from its first 64 (splitmix finalizer)."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    places = h.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.intp)
    places += _PLACES
    seen = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def shingles(text: str | None, spec: SimHash) -> Iterator[np.ndarray]:
    """The 64-bit hashes of a text's shingles in order, in arrays of bounded size; none without words."""
    total, kept = 0, []
    digest = xxhash.xxh64_digest
    for words in _chunks((text or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
        words = kept + words
        if len(words) < spec.words:
            kept = words
            continue
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        starts, ends = starts[: len(words) - spec.words + 1], ends[spec.words - 1:]
        for a in range(0, len(starts), 1 << 16):
            spans = zip(starts[a:a + (1 << 16)].tolist(), ends[a:a + (1 << 16)].tolist(), strict=True)
            h = np.frombuffer(b"".join([digest(data[s:e], SEED) for s, e in spans]), ">u8").astype(np.uint64)
            total += len(h)
            yield h
        kept = words[len(words) - spec.words + 1:]
    if not total and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def shingle_set(text: str | None, spec: SimHash) -> np.ndarray:
    """The different shingle hashes of a text, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingles(text, spec)]))


def packed(hashes: Iterable[np.ndarray], spec: SimHash) -> list[int]:
    """The signed 64-bit parts of the fingerprint of some shingle hashes; all zero for none."""
    parts = spec.bits // 64
    counts, total = np.zeros((parts, 64), np.int64), 0
    for h in hashes:
        total += len(h)
        for k in range(parts):
            counts[k] += _bit_counts(_mixed(h, k) if k else h)
    rows = np.packbits((2 * counts > total).astype(np.uint8), axis=1)
    return [int.from_bytes(row.tobytes(), "big", signed=True) for row in rows]


def fingerprint(text: str | None, spec: SimHash) -> list[int]:
    """The signed 64-bit parts of one text's fingerprint; all zero without words."""
    return packed([shingle_set(text, spec)] if spec.distinct else shingles(text, spec), spec)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, spec: SimHash) -> DataFrame:
    """``(id, f0, f1, ...)``, one row per document.

    A null or blank text has the fingerprint zero; a text with fewer words than a
    shingle is one shingle.  Repeated shingles count as often as they occur.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(text, spec) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([row[k] for row in found], pa.int64()) for k in range(len(spec.columns)))],
            ["id", *spec.columns])

    schema = "id long, " + ", ".join(f"{c} long" for c in spec.columns)
    return map_slices(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, schema)


def tile_stars(nodes: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int,
               tile: int = 512, pending: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between fingerprints ``a`` (n x parts) and ``b``, reduced to stars.

    ``left`` and ``right`` give their positions in the ascending ``nodes``.  Rows
    are ordered by half counts so that tiles can be passed over; at most
    ``pending`` links are held before they are reduced.
    """
    count = np.bitwise_count

    def ordered(at, prints):
        halves = np.stack([count(prints >> np.uint64(32)).sum(axis=1, dtype=np.int64),
                           count(prints & np.uint64(0xFFFFFFFF)).sum(axis=1, dtype=np.int64)], axis=1)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        halves, prints = halves[order], prints[order]
        cuts = range(0, len(at), tile)
        low = np.array([halves[i:i + tile].min(axis=0) for i in cuts])
        high = np.array([halves[i:i + tile].max(axis=0) for i in cuts])
        total = halves.sum(axis=1)
        return at[order], np.ascontiguousarray(prints.T), low, high, \
            np.array([total[i:i + tile].min() for i in cuts]), np.array([total[i:i + tile].max() for i in cuts])

    empty = np.zeros(0, np.int64)
    if not len(a) or not len(b):
        return empty, empty
    # So many parts are compared in full that unlike fingerprints seldom pass them.
    parts = a.shape[1]
    full = next((k for k in range(2, parts) if 32 * k - 12 * k ** 0.5 >= radius), parts)
    at_a, a, low_a, high_a, min_a, max_a = ordered(left, a)
    at_b, b, low_b, high_b, min_b, max_b = ordered(right, b)
    found_l, found_r, held = [], [], 0

    def reduced():
        label = spanning_stars(len(nodes), np.concatenate(found_l), np.concatenate(found_r))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return [moved], [label[moved]], len(moved)

    for i in range(len(low_a)):
        halves = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        whole = np.maximum(min_b - max_a[i], min_a[i] - max_b)
        x = a[:, i * tile:(i + 1) * tile]
        for j in np.flatnonzero((halves <= radius) & (whole <= radius)).tolist():
            y = b[:, j * tile:(j + 1) * tile]
            apart = count(x[0][:, None] ^ y[0][None, :])
            if len(x) > 1:
                apart = apart.astype(np.uint16)
                for k in range(1, full):
                    apart += count(x[k][:, None] ^ y[k][None, :])
            p, q = np.nonzero(apart <= radius)
            if len(x) > full and len(p):
                rest = apart[p, q].astype(np.int64)
                for k in range(full, len(x)):
                    rest += count(x[k][p] ^ y[k][q])
                p, q = p[rest <= radius], q[rest <= radius]
            l, r = at_a[i * tile + p], at_b[j * tile + q]
            apart = l != r
            if apart.any():
                found_l.append(l[apart])
                found_r.append(r[apart])
                held += len(found_l[-1])
                if held > pending:
                    found_l, found_r, held = reduced()
    if not held:
        return empty, empty
    found_l, found_r, _ = reduced()
    return nodes[found_l[0]], nodes[found_r[0]]


def _blocks(per_count: list[tuple[int, int]], spec: SimHash) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """By population count: its first block and how many it has; and each block's lowest and highest count."""
    total = sum(n for _, n in per_count)
    size = min(spec.max_block, max(256, ceil(total / spec.blocks)))
    of, spans, filled = {}, [], size
    for ones, n in sorted(per_count):
        if n >= size:
            k = ceil(n / size)
            of[ones] = (len(spans), k)
            spans += [(ones, ones)] * k
            filled = size
        elif filled + n > size:
            of[ones] = (len(spans), 1)
            spans.append((ones, ones))
            filled = n
        else:
            of[ones] = (len(spans) - 1, 1)
            spans[-1] = (spans[-1][0], ones)
            filled += n
    return of, spans


def _ones(spec: SimHash) -> Column:
    ones = F.bit_count("f0")
    for c in spec.columns[1:]:
        ones = ones + F.bit_count(c)
    return ones


def near_links(prints: DataFrame, spec: SimHash) -> DataFrame:
    """Stars ``(src, dst)`` that join all of ``prints(node, f0, ...)`` within the radius of each other."""
    session = prints.sparkSession
    per_count = [(r.ones, r.n) for r in prints.groupBy(_ones(spec).alias("ones")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not per_count:
        return session.createDataFrame([], "src long, dst long")
    of, spans = _blocks(per_count, spec)
    first = [next(a for a, s in enumerate(spans) if s[1] >= low - spec.radius) for low, _ in spans]
    last = [max(b for b, s in enumerate(spans) if s[0] <= high + spec.radius) for _, high in spans]
    pairs = sum(last[b] - b + 1 for b in range(len(spans)))
    starts = session.createDataFrame(
        [(ones, block, k) for ones, (block, k) in of.items()], "ones int, first_block int, sub_blocks int")
    reach = session.createDataFrame([(b, first[b], last[b]) for b in range(len(spans))], "block int, lo int, hi int")
    blocked = (
        prints.withColumn("ones", _ones(spec).cast("int")).join(F.broadcast(starts), "ones")
        .withColumn("block", (F.col("first_block") + F.pmod(F.xxhash64("node"), F.col("sub_blocks"))).cast("int"))
        .join(F.broadcast(reach), "block")
        .select("node", *spec.columns, "block", F.explode(F.sequence("lo", "hi")).alias("other"))
        .withColumn("pair", F.least("block", "other").cast("long") * len(spans) + F.greatest("block", "other"))
    )
    radius, columns = spec.radius, spec.columns

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].to_numpy()
        ids = pdf["node"].to_numpy()
        nodes = np.unique(ids)
        at = np.searchsorted(nodes, ids)
        prints = pdf[columns].to_numpy(np.int64).view(np.uint64).reshape(-1, len(columns))
        low = block == block.min()
        high = low if low.all() else ~low
        # A pair of two blocks of which one is empty compares nothing: the block's own pair does that.
        alone = low.all() and int(pdf["other"].iloc[0]) != int(block[0])
        none = np.zeros(0, np.int64)
        src, dst = (none, none) if alone else tile_stars(nodes, at[low], at[high], prints[low], prints[high], radius)
        return pd.DataFrame({"src": src, "dst": dst})

    tasks = max(1, min(4096, ceil(pairs / 2)))
    return (
        blocked.select("pair", "block", "other", "node", *columns).repartition(tasks, "pair")
        .groupBy("pair").applyInPandas(compare, "src long, dst long")
    )


def near_duplicates(docs: DataFrame, spec: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, f0, ..., component)`` for every row: the smallest id among the near copies reached from it.

    Copies share a fingerprint and are compared once, under a number of their own.
    Repeated ids are rows of their own.  Rows without an id keep their
    fingerprint; their component is that of the fingerprint's other rows, or
    null when it has none.  An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col, spec))
    distinct = durable(prints.groupBy(*spec.columns).agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    stars = components(near_links(distinct.where("least is not null").drop("least"), spec))
    grouped = distinct.join(stars, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    names = grouped.groupBy("group").agg(F.min("least").alias("component"))
    return prints.join(grouped.join(names, "group").select(*spec.columns, "component"), spec.columns)
