"""Ranked search over per-term blocks of similar documents, exact.

Documents become sparse vectors, stored, over the terms that a batch of items asks
for.  A segment of the index holds some thousand vectors and, for every term, its
posting list clustered by document similarity: each cluster is a block with the
coordinatewise maximum of its vectors.  The weighted sum of a block's maxima
bounds every score in it, so a block is skipped only when that bound is below
the score that an item's list of best documents asks for already.  Terms that a
part of a segment holds share one clustering of the whole segment; in the bound of a
rarer term's block they count as in the best cluster that the block's documents come from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelantern.operators.sizing import durable

#: A term is a longest run of these; all signs below 0x80 but digits and letters are between terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: what is no part of a term becomes a blank, A-Z small.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()
_STRETCH = 1 << 20


@dataclass(frozen=True)
class BlockSearch:
    best: int = 10                  #: documents per item
    segment_docs: int = 2048        #: of a segment; one with as many postings as below is closed sooner
    segment_postings: int = 250_000
    block_docs: int = 16            #: documents of a block, about
    shared_share: float = 0.015625   #: a term of more than this share of a segment uses the segment's own clusters
    sketch: int = 16                #: dimensions in which likeness is measured
    item_bytes: int = 32 << 20      #: of item texts that every task may hold; larger batches go in parts
    salts: int = 16                 #: parts of a term's postings where the vocabulary is joined


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def _counted(text: bytes, numbers: dict[bytes, int] | None) -> tuple[int, Counter]:
    """Terms of a text, and how often each comes; only numbered ones, by their numbers (from 1), if there are numbers."""
    folded, n, counts, at = text.translate(_FOLD), 0, Counter(), 0
    while at < len(folded):
        cut = folded.find(b" ", at + _STRETCH)
        words = folded[at:cut if cut >= 0 else len(folded)].split()
        at = cut if cut >= 0 else len(folded)
        n += len(words)
        counts.update(words if numbers is None else filter(None, map(numbers.get, words)))
    return n, counts


def term_counts(docs: DataFrame, id_col: str, text_col: str, numbers: dict[bytes, int] | None) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of documents with a term; ``terms`` are numbers, or without ``numbers`` all terms."""
    kind = pa.string() if numbers is None else pa.int64()
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                ids, ns, terms, tfs = [], [], [], []
                part = batch.slice(start, 256)
                for doc, text in zip(part.column(0), part.column(1).cast(pa.binary()), strict=True):
                    n, counts = _counted(text.as_py() or b"", known)
                    if n:
                        ids.append(doc.as_py())
                        ns.append(n)
                        terms.append([t.decode() for t in counts] if known is None else list(counts))
                        tfs.append(list(counts.values()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(kind)), pa.array(tfs, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "tf"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(count, f"doc_id long, n long, terms array<{'string' if numbers is None else 'long'}>, tf array<long>")


def _numbered_by_join(counted: DataFrame, vocabulary: DataFrame, salts: int) -> DataFrame:
    """Term counts with numbers for terms, for a vocabulary that no task should hold; common terms are split by row."""
    rows = durable(counted.withColumn("row", F.monotonically_increasing_id()))
    flat = rows.select("row", F.explode_outer(F.arrays_zip("terms", "tf")).alias("p")).select("row", "p.terms", "p.tf")
    salted = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = flat.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).withColumnRenamed("terms", "term").join(salted, ["term", "salt"])
    lists = hits.groupBy("row").agg(F.collect_list(F.struct("number", "tf")).alias("p"))
    empty = F.array().cast("array<long>")
    return rows.select("row", "doc_id", "n").join(lists, "row", "left").select(
        "doc_id", "n", F.coalesce("p.number", empty).alias("terms"), F.coalesce("p.tf", empty).alias("tf"))


# -- the index ---------------------------------------------------------------------------------
def _pointers(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _nearest(sketch: np.ndarray, size: int) -> np.ndarray:
    """Numbers of clusters of about ``size`` rows: rows go to the most similar of evenly spread centres."""
    centres = sketch[np.linspace(0, len(sketch) - 1, ceil(len(sketch) / size)).astype(np.int64)]
    return np.argmax(sketch @ centres.T, axis=1)


def _maxima(group: np.ndarray, term: np.ndarray, impact: np.ndarray, n_groups: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinatewise maxima of groups of postings: pointers by group, terms, maxima."""
    key = group * n_terms + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(impact[order], starts) if len(key) else impact
    found = key[starts]
    return _pointers(np.bincount(found // n_terms, minlength=n_groups)), found % n_terms, most


def segment_of(ids: np.ndarray, valid: np.ndarray, ptr: np.ndarray, number: np.ndarray, impact: np.ndarray, spec: BlockSearch) -> dict[str, np.ndarray]:
    """The arrays of a segment from its documents' vectors (each with a term at least)."""
    names, term = np.unique(number, return_inverse=True)
    n, n_terms, sizes = len(ids), len(names), np.diff(ptr)
    doc = np.repeat(np.arange(n), sizes)
    df = np.bincount(term, minlength=n_terms)
    shared = df > max(spec.block_docs, spec.shared_share * n)
    signs = np.stack([(names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40 + i)) & np.uint64(1) for i in range(spec.sketch)], axis=1)
    pull = (signs.astype(np.float32) * 2 - 1) * np.log((n + 1) / df).astype(np.float32)[:, None]
    sketch = np.add.reduceat(pull[term] * impact[:, None].astype(np.float32), ptr[:-1])
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)

    whole = _nearest(sketch, spec.block_docs)
    n_clusters = int(whole.max()) + 1
    wide_ptr, wide_term, wide = _maxima(whole[doc], term, impact, n_clusters, n_terms)

    rare = ~shared[term]
    by_term = np.argsort(term[rare], kind="stable")
    members, owner = doc[rare][by_term], term[rare][by_term]
    lists = _pointers(np.bincount(owner, minlength=n_terms))
    inside = np.zeros(len(members), np.int64)
    for t in np.flatnonzero(np.diff(lists) > spec.block_docs):
        inside[lists[t]:lists[t + 1]] = _nearest(sketch[members[lists[t]:lists[t + 1]]], spec.block_docs)
    place = owner * (n + 1) + inside
    order = np.argsort(place, kind="stable")
    members, place = members[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    block_sizes = np.diff(np.append(starts, len(place)))
    first = _pointers(np.bincount(place[starts] // (n + 1), minlength=n_terms))
    # A block's summary: of all rarer terms of its documents.
    rare_ptr = _pointers(np.bincount(doc[rare], minlength=n))
    width = np.diff(rare_ptr)[members]
    at = _ranges(rare_ptr[:-1][members], width)
    block = np.repeat(np.repeat(np.arange(len(starts)), block_sizes), width)
    most_ptr, most_term, most = _maxima(block, term[rare][at], impact[rare][at], len(starts), n_terms)
    return {
        "ids": ids, "valid": valid, "names": names, "shared": shared, "ptr": ptr, "term": term, "impact": impact,
        "first": first, "member_ptr": _pointers(block_sizes), "member": members, "most_ptr": most_ptr, "most_term": most_term, "most": most,
        "home": whole, "cluster_ptr": _pointers(np.bincount(whole, minlength=n_clusters)), "cluster": np.argsort(whole, kind="stable"),
        "wide_ptr": wide_ptr, "wide_term": wide_term, "wide": wide,
    }


def _segments(batch: pa.RecordBatch, n_docs: int, n_words: int, spec: BlockSearch) -> Iterator[dict[str, np.ndarray]]:
    held = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
    if not held.num_rows:
        return
    sizes = pc.list_value_length(held.column("terms")).to_numpy().astype(np.int64)
    ptr = _pointers(sizes)
    number = held.column("terms").flatten().to_numpy()
    tf = held.column("tf").flatten().to_numpy()
    m = 10 + (90 * held.column("n").to_numpy() * n_docs) // n_words
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes))
    valid = held.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(held.column("doc_id"), 0).to_numpy()
    at = 0
    while at < len(ids):
        end = min(len(ids), at + spec.segment_docs, max(at + 1, int(np.searchsorted(ptr, ptr[at] + spec.segment_postings, side="right")) - 1))
        here = slice(ptr[at], ptr[end])
        yield segment_of(ids[at:end], valid[at:end], ptr[at:end + 1] - ptr[at], number[here], impact[here], spec)
        at = end


# -- the search --------------------------------------------------------------------------------
class BestDocuments:
    """The best documents per item over the segments it has been shown; counts the blocks it read and skipped."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], best: int):
        self.items, self.k = items, best          # (item, ascending term numbers, weights)
        none = np.zeros(0, np.int64)
        self.found = {item: (none, none, none.astype(bool)) for item, _, _ in items}
        self.blocks, self.read = 0, 0

    def _least(self, item: int) -> int:
        scores = self.found[item][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def _add(self, item: int, s: dict[str, np.ndarray], docs: np.ndarray, weights: np.ndarray) -> None:
        sizes = np.diff(s["ptr"])[docs]
        at = _ranges(s["ptr"][:-1][docs], sizes)
        scores = np.add.reduceat(weights[s["term"][at]] * s["impact"][at], _pointers(sizes)[:-1])
        good = scores >= self._least(item)
        old = self.found[item]
        scores = np.concatenate([old[0], scores[good]])
        ids = np.concatenate([old[1], s["ids"][docs[good]]])
        valid = np.concatenate([old[2], s["valid"][docs[good]]])
        order = np.lexsort((ids, ~valid, -scores))[:self.k]
        self.found[item] = scores[order], ids[order], valid[order]

    def show(self, s: dict[str, np.ndarray]) -> None:
        for item, numbers, wanted in self.items:
            at = np.searchsorted(s["names"], numbers)
            at[at == len(s["names"])] = 0
            held = s["names"][at] == numbers
            terms, wanted = at[held], wanted[held]
            if len(terms):
                self._search(item, s, terms, wanted)

    def _search(self, item: int, s: dict[str, np.ndarray], terms: np.ndarray, wanted: np.ndarray) -> None:
        weights = np.zeros(len(s["names"]), np.int64)
        weights[terms] = wanted
        # What shared terms can give a document, by its cluster.
        only = np.where(s["shared"], weights, 0)
        given = np.add.reduceat(only[s["wide_term"]] * s["wide"], s["wide_ptr"][:-1])
        seen = np.zeros(len(s["ids"]), bool)
        rare = terms[~s["shared"][terms]]
        blocks = _ranges(s["first"][rare], s["first"][rare + 1] - s["first"][rare])
        if len(blocks):
            sizes = s["most_ptr"][blocks + 1] - s["most_ptr"][blocks]
            entry = _ranges(s["most_ptr"][blocks], sizes)
            bounds = np.add.reduceat(weights[s["most_term"][entry]] * s["most"][entry], _pointers(sizes)[:-1])
            sizes = s["member_ptr"][blocks + 1] - s["member_ptr"][blocks]
            members = s["member"][_ranges(s["member_ptr"][blocks], sizes)]
            bounds += np.maximum.reduceat(given[s["home"][members]], _pointers(sizes)[:-1])
            self._read_in_waves(item, s, s["member_ptr"], s["member"], blocks, bounds, seen, weights)
        # Whoever is unseen now holds shared terms only, or was in blocks that cannot reach the list.
        some = np.flatnonzero(given)
        if len(some):
            self._read_in_waves(item, s, s["cluster_ptr"], s["cluster"], some, given[some], seen, weights)

    def _read_in_waves(
        self, item: int, s: dict[str, np.ndarray], ptr: np.ndarray, member: np.ndarray, groups: np.ndarray, bounds: np.ndarray,
        seen: np.ndarray, weights: np.ndarray,
    ) -> None:
        """Read blocks by falling bound in waves that double, until no bound reaches the list as it stands then."""
        self.blocks += len(groups)
        order, at, size = np.argsort(-bounds, kind="stable"), 0, 2
        while at < len(order) and bounds[order[at]] >= self._least(item):
            part = order[at:at + size]
            part = groups[part[bounds[part] >= self._least(item)]]
            self.read += len(part)
            docs = np.unique(member[_ranges(ptr[part], ptr[part + 1] - ptr[part])])
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                self._add(item, s, docs, weights)
            at, size = at + size, 2 * size

    def rows(self) -> pa.RecordBatch:
        items = np.repeat(np.array([i for i in self.found], np.int64), [len(f[0]) for f in self.found.values()])
        scores, ids, valid = (np.concatenate([f[i] for f in self.found.values()]) if self.found else np.zeros(0, np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(ids, pa.int64(), mask=~valid.astype(bool)), pa.array(scores, pa.int64())],
            names=["item", "doc_id", "score"])


def search(vectors: DataFrame, n_docs: int, n_words: int, items: list[tuple[int, np.ndarray, np.ndarray]], spec: BlockSearch) -> DataFrame:
    """``(item, doc_id, score)``: each task's best documents for every item, ``spec.best`` at most.

    A task makes its segments from the vectors that it reads and keeps one at a time, with the lists of
    best documents; segments are not written, as they take more room than the vectors.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestDocuments(shared.value, spec.best)
        for batch in batches:
            for segment in _segments(batch, n_docs, n_words, spec):
                best.show(segment)
        yield best.rows()

    return vectors.select("doc_id", "n", "terms", "tf").mapInArrow(run, "item long, doc_id long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, spec: BlockSearch = BlockSearch(), *,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the best documents of each row of ``items`` with a score above 0.

    Equal scores go by ascending id, null ids last; rows that share an id are
    documents (or items) of their own.  Null and empty texts, and texts without a
    term, are no documents, and such items have no rows; so have all items without documents.
    Other columns are left out.

    Items are held by tasks only while their texts are measured to be under
    ``item_bytes``; more of them are dealt into parts of that size by a hash, searched one after
    the other over the same stored vectors, and their terms are numbered by a join.
    """
    session = docs.sparkSession
    asked = durable(items.select(F.col(item_col).alias("item_id"), terms_of(F.col(item_text_col)).alias("terms")).withColumn(
        "item", F.monotonically_increasing_id()))
    pairs = asked.select("item", F.explode_outer(F.array_distinct("terms")).alias("term")).where("term is not null")
    nbytes = asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + 16 * F.size("terms"))).first()[0] or 0
    parts = max(1, ceil(nbytes / spec.item_bytes))
    words = pairs.select("term").distinct()
    if parts == 1:
        numbers = {row.term.encode(): i for i, row in enumerate(words.orderBy("term").collect(), 1)}
        vectors = durable(term_counts(docs, id_col, text_col, numbers))
        vocabulary = session.createDataFrame([(t.decode(), i) for t, i in numbers.items()], "term string, number long")
    else:
        vocabulary = durable(words.withColumn("number", F.monotonically_increasing_id()))
        vectors = durable(_numbered_by_join(term_counts(docs, id_col, text_col, None), vocabulary, spec.salts))
    n_docs, n_words = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = vectors.select(F.explode_outer("terms").alias("number")).where("number is not null").groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = durable(pairs.join(vocabulary, "term").join(df, "number").select("item", "number", weight.alias("weight")))
    scored = []
    for part in range(parts):
        chosen = weighed.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        lists = chosen.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("number", "weight"))).alias("terms")).collect()
        batch = [(r.item, np.array([t.number for t in r.terms], np.int64), np.array([t.weight for t in r.terms], np.int64)) for r in lists]
        scored.append(search(vectors, n_docs, n_words or 1, batch, spec))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, scored).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.best)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
