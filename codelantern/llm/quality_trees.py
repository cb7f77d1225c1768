"""Quality of a document: gradient-boosted trees over statistics of its text.

Trees are grown on histograms of binned statistics and kept as flat arrays, so a
batch of documents walks down all of them with a few numpy look-ups per level.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern.llm.frames import add_columns, hash_share

STATISTICS = (
    "chars", "words", "word_chars", "distinct_words", "top_word", "repeats", "lines", "distinct_lines", "line_words",
    "letters", "upper", "digits", "spaces", "stops", "marks", "symbols", "pipes", "bangs", "longest_word", "ended_lines",
    "short_words", "wide_chars",
)
_WORD_END = re.compile(r"[.!?]$")
_CLASS = np.zeros(256, np.intp)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\x0b\x0c",
                             b".", b",;:'\"()-", b"#$%&*@^~_=+<>{}[]\\/`", b"|", b"!?"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:192], _CLASS[192:] = 10, 11


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, in the order of ``STATISTICS``; all zero for null and empty texts."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = sum(np.bincount(_CLASS[data[i:i + (1 << 18)]], minlength=12) for i in range(0, len(data), 1 << 18))
    n = len(text)
    words = text.split()
    counts, lines = Counter(words), [x for x in text.split("\n") if x]
    m, k = max(1, len(words)), max(1, len(lines))
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, len(counts) / m, max(counts.values(), default=0) / m,
        repeats / m, np.log1p(len(lines)), len(set(lines)) / k, len(words) / k, (seen[1] + seen[2] + seen[11]) / n,
        seen[1] / n, seen[3] / n, seen[4] / n, seen[5] / n, seen[6] / n, seen[7] / n, seen[8] / n, seen[9] / n,
        np.log1p(max(map(len, words), default=0)), sum(1 for x in lines if _WORD_END.search(x)) / k,
        sum(1 for w in words if len(w) <= 3) / m, seen[11] / n,
    ]


@dataclass(frozen=True)
class TreeFit:
    sample: int = 20_000      #: expected labelled documents that are learned from
    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    least: float = 2.0        #: sum of second derivatives in a leaf at least
    ridge: float = 1.0


@dataclass
class Forest:
    """Complete binary trees in flat arrays: node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray       #: trees x inner nodes
    cut: np.ndarray           #: trees x inner nodes; a value up to the cut goes left
    value: np.ndarray         #: trees x leaves
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.start)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.intp)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, spec: TreeFit) -> Forest:
    """Boosted trees for the logistic loss.  Without rows every score is one half; with one label only, near that label."""
    inner = 2 ** spec.depth - 1
    features, cuts, values = [], [], []
    if not len(y):
        return Forest(np.zeros((0, inner), np.intp), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, spec.bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    d, total = x.shape[1], np.full(len(y), start)
    slots = binned + np.arange(d) * spec.bins
    for _ in range(spec.trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.intp), np.full(inner, np.inf)
        node = np.zeros(len(y), np.intp)
        for level in range(spec.depth):
            first, width = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * (d * spec.bins) + slots).ravel()
            size = width * d * spec.bins
            sums = [np.bincount(at, np.repeat(w, d), size).reshape(width, d, spec.bins) for w in (g, h)]
            left_g, left_h = sums[0].cumsum(axis=2), sums[1].cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + spec.ridge) + right_g ** 2 / (right_h + spec.ridge) - all_g ** 2 / (all_h + spec.ridge)
            gain[(left_h < spec.least) | (right_h < spec.least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                f, edge = divmod(b, spec.bins)
                if gain[k, f, edge] > 1e-9 and edge < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][edge]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = spec.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + spec.ridge)
        total += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(np.array(features), np.array(cuts), np.array(values), start)


def _table(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], dtype=float).reshape(-1, len(STATISTICS))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, spec: TreeFit = TreeFit(), id_col: str = "doc_id",
                text_col: str = "text", label_col: str = "quality") -> Forest:
    """Learn from the documents where ``learn`` holds and that have a label of 0 or 1.

    A document with several labels takes the largest, one with several texts the smallest statistics.  About ``sample`` of the
    labelled documents, fixed by a hash of their id, are learned from.
    """
    marked = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(label_col).cast("double").alias("_label"))
    )
    n = marked.count()
    sample = marked.where(hash_share("_id") < F.lit(min(1.0, spec.sample / max(1, n))))

    def measured(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(_table(texts).tolist(), pa.list_(pa.float64()))]

    # The sample is bounded by its parameter, so it can be sent to the texts.
    texts = docs.where(learn).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = add_columns(texts.join(F.broadcast(sample), "_id"), ["_text"], measured, "x array<double>")
    rows = found.groupBy("_id").agg(F.min("x").alias("x"), F.max("_label").alias("_label")).toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
    order = np.lexsort([*x.T, rows["_label"]])  # rows arrive in any order; sums must not depend on it
    return grow(x[order], rows["_label"].to_numpy(float)[order], spec)


def score_quality(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); columns of those names are replaced.

    Null and empty texts are scored as texts without any content.
    """
    handle = docs.sparkSession.sparkContext.broadcast(forest)

    def score(texts: pa.Array) -> list[pa.Array]:
        scores = handle.value.scores(_table(texts))
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    return add_columns(docs, [text_col], score, "score double, predicted int")
