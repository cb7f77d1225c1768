"""Near-duplicate vectors: a forest of random-projection trees with spill overlap.

Trees are fitted on a bounded sample: a node splits at the sample's median of a
random projection, and vectors close to the cut go to both sides, so a close
pair is parted only if it lies far apart along that direction.  All vectors go
down all trees.  A leaf that holds too many of them in the end, since the table is
large for its sample, grows a tree of its own from a sample of its own vectors, level by
level, until leaves are small or do not split.  The vectors of a leaf are compared
exactly, in tiles of bounded size however large the leaf is.

A pair is counted in the first leaf it shares, in the order of trees and leaves:
tasks see the leaves of each vector, so links are counted without ever being
sent, and only stars of each tile's links travel to the union.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern.config import SearchOptions
from codelantern.llm.components import components, spanning_stars
from codelantern.llm.frames import hash_share
from codelantern.operators.sizing import durable, hinted, is_small

#: Passes over leaves that are still too large; each at least takes a fifth off a leaf that splits.
MOST_LEVELS = 40
#: Groups of tile pairs at most.
MOST_TASKS = 100_000


@dataclass(frozen=True)
class ForestFit:
    cosine: float = 0.95       #: least cosine of a link
    trees: int = 4
    leaf: int = 768            #: vectors of a leaf, as the sample predicts them, above which a node splits
    spill: float = 1.3         #: half width of the overlap, in root mean squares of a linked pair's half distance along a direction
    sample: int = 20_000       #: expected vectors that the trees are fitted on
    leaf_sample: int = 512     #: expected vectors that a leaf's own tree is fitted on
    dense: float = 0.8         #: a node is left whole if a side would get more than this share of it
    tile: int = 1024           #: vectors of a tile of a larger leaf
    seed: int = 3


@dataclass
class Tree:
    """Nodes in flat arrays; ``child`` is (left, right), or (-1, leaf number)."""

    direction: np.ndarray
    cut: np.ndarray
    child: np.ndarray

    def leaves(self, x: np.ndarray, margin: float) -> list[np.ndarray]:
        """For each leaf number, the rows of ``x`` that fall into it, in the order in which leaves are reached."""
        found, stack = [], [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            left, right = self.child[node]
            if left < 0:
                found.append((int(right), rows))
                continue
            along = x[rows] @ self.direction[node] - self.cut[node]
            stack.append((int(right), rows[along >= -margin]))
            stack.append((int(left), rows[along <= margin]))
        return found


def margin_of(spec: ForestFit, dims: int) -> float:
    return spec.spill * sqrt(max(0.0, 2 - 2 * spec.cosine)) / sqrt(max(1, dims)) / 2


def fit_tree(x: np.ndarray, per_row: float, spec: ForestFit, seed: int | list[int]) -> Tree:
    """A tree on unit vectors ``x``, each standing for ``per_row`` vectors."""
    rng = np.random.default_rng(seed)
    margin = margin_of(spec, x.shape[1])
    directions, cuts, children, leaves = [], [], [], 0
    stack = [(np.arange(len(x)), -1, 0)]
    while stack:
        rows, parent, side = stack.pop()
        if parent >= 0:
            children[parent][side] = len(children)
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction) or 1.0
        along = x[rows] @ direction
        # At the median, or beside it where that lies in a dense group.
        for share in (0.5, 0.4, 0.6, 0.3, 0.7):
            cut = float(np.quantile(along, share)) if len(rows) else 0.0
            left, right = rows[along <= cut + margin], rows[along >= cut - margin]
            if max(len(left), len(right)) <= spec.dense * len(rows):
                break
        directions.append(direction)
        cuts.append(cut)
        if len(rows) * per_row <= spec.leaf or len(rows) < 16 or max(len(left), len(right)) > spec.dense * len(rows):
            children.append([-1, leaves])
            leaves += 1
        else:
            children.append([0, 0])
            stack += [(right, len(children) - 1, 1), (left, len(children) - 1, 0)]
    return Tree(np.array(directions), np.array(cuts), np.array(children))


def link_tile(ids: np.ndarray, x: np.ndarray, weight: np.ndarray, marks: list[np.ndarray], leaf: int, left: np.ndarray,
              right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows ``left`` and ``right`` of a leaf: ids, their links counted here, and the smallest id reached.

    ``marks`` holds each row's leaves in ascending order; a pair that shares an
    earlier leaf than ``leaf`` was counted there.
    """
    close = x[left] @ x[right].T >= cosine
    close &= ids[left][:, None] != ids[right][None, :]
    p, q = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(p):
        none = np.zeros(0, np.int64)
        return none, none, none
    close = close[np.ix_(p, q)]
    left, right = left[p], right[q]
    counted = close.copy()
    earlier = np.unique(np.concatenate([m[m < leaf] for m in (marks[i] for i in {*left.tolist(), *right.tolist()})]))
    if len(earlier):
        def incidence(rows):
            at = np.zeros((len(rows), len(earlier)), np.float32)
            for i, row in enumerate(rows.tolist()):
                own = marks[row]
                at[i, np.searchsorted(earlier, own[own < leaf])] = 1
            return at
        counted &= ~(incidence(left) @ incidence(right).T > 0)
    rows = np.unique(np.concatenate([left, right]))
    links = np.zeros(len(rows), np.int64)
    at_l, at_r = np.searchsorted(rows, left), np.searchsorted(rows, right)
    same = len(left) == len(right) and np.array_equal(left, right)
    np.add.at(links, at_l, counted @ weight[right])
    if not same:
        np.add.at(links, at_r, counted.T @ weight[left])
    order = np.argsort(ids[rows], kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(rows))
    a, b = np.nonzero(close)
    label = spanning_stars(len(rows), rank[at_l[a]], rank[at_r[b]])
    return ids[rows], links, ids[rows][order][label[rank]]


def near_vectors(vectors: DataFrame, spec: ForestFit = ForestFit(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component)`` for every row.

    Equal vectors are compared once and counted as often as they occur.  Null,
    empty and zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths.  Rows that share an id are rows
    of their own; a row without an id gives no component to others.  An empty table gives an
    empty result.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.withColumn("usable", F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0), F.lit(False)))
    # -0.0 and 0.0 are one value, so that equal vectors meet in one group.
    rows = rows.withColumn("vector", F.when(F.col("usable"), F.transform(v, lambda c: F.when(c == 0, F.abs(c)).otherwise(c))))
    distinct = durable(
        rows.where("usable").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()))
    found = durable(_tile_links(distinct, spec))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("node").alias("src"), F.col("least").alias("dst")))
    grouped = distinct.join(stars, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    smallest = grouped.groupBy("group").agg(F.min("id").alias("component"))
    told = grouped.join(smallest, "group").join(links, "node", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return rows.where("usable").join(told, "vector").select("id", "n_links", "component").unionByName(alone)


def leaf_sizes(marked: DataFrame) -> DataFrame:
    """``(leaf, n)``: the vectors of each leaf."""
    return marked.select(F.explode("marks").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


def refined(marked: DataFrame, spec: ForestFit) -> DataFrame:
    """``marked(node, weight, vector, marks)`` with leaves of more than twice ``spec.leaf`` vectors split on.

    Each pass fits trees on samples of the large leaves, one leaf per group, and sends those leaves' vectors down
    them.  A leaf stays large only if no direction splits it, as when its vectors are nearly one.
    """
    room = 2 * spec.leaf
    if leaf_sizes(marked).where(F.col("n") > room).isEmpty():
        return marked
    open_, done = marked.select("node", "vector", F.explode("marks").alias("leaf")), []
    for level in range(MOST_LEVELS):
        large = durable(open_.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > room))
        if large.isEmpty():
            break
        few = hinted(large, is_small(large, SearchOptions(), F.lit(16)))
        done.append(open_.join(few, "leaf", "left_anti").select("node", "leaf"))
        big = durable(open_.join(few, "leaf"))
        trees = durable(
            big.where(hash_share("vector", "leaf") < F.lit(float(spec.leaf_sample)) / F.col("n")).groupBy("leaf")
            .applyInPandas(_own_tree(spec, level), "leaf long, direction array<double>, cut array<double>, child array<int>"))
        small = is_small(trees, SearchOptions(), 8 * F.size("direction") + 16 * F.size("cut"))
        sent = big.join(hinted(trees, small), "leaf", "left")
        done.append(sent.where("child is null").select("node", "leaf"))
        split = sent.where("child is not null").select(
            "node", "vector", "leaf", F.explode(_sent_down(spec)("vector", "leaf", "direction", "cut", "child")).alias("part"))
        open_ = durable(split.select("node", "vector", F.xxhash64("leaf", "part").alias("leaf")))
    done.append(open_.select("node", "leaf"))
    marks = reduce(DataFrame.unionByName, done).groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("marks"))
    return durable(marked.drop("marks").join(marks, "node"))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.tolist()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _own_tree(spec: ForestFit, level: int):
    """The tree of one leaf as a row, or no row if several directions do not split it."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, n = int(pdf["leaf"].iloc[0]), int(pdf["n"].iloc[0])
        x = _unit(pdf["vector"])
        x = x[np.lexsort(x.T)]
        for attempt in range(4):
            tree = fit_tree(x, n / len(x), spec, [spec.seed, level, attempt, leaf & (1 << 63) - 1])
            if len(tree.child) > 1:
                return pd.DataFrame({"leaf": [leaf], "direction": [tree.direction.ravel()], "cut": [tree.cut], "child": [tree.child.ravel().astype(np.int32)]})
        return pd.DataFrame({"leaf": pd.Series([], dtype="int64")} | dict.fromkeys(("direction", "cut", "child"), pd.Series([], dtype=object)))

    return fit


def _sent_down(spec: ForestFit):
    """A function that gives each vector the leaves that it reaches in its own leaf's tree."""

    @F.pandas_udf("array<int>")
    def parts(vector: pd.Series, leaf: pd.Series, direction: pd.Series, cut: pd.Series, child: pd.Series) -> pd.Series:
        found = [[] for _ in range(len(leaf))]
        for rows in leaf.groupby(leaf).indices.values():
            x = _unit(vector.iloc[rows])
            one = rows[0]
            tree = Tree(np.asarray(direction.iloc[one]).reshape(-1, x.shape[1]), np.asarray(cut.iloc[one]), np.asarray(child.iloc[one]).reshape(-1, 2))
            for number, inside in tree.leaves(x, margin_of(spec, x.shape[1])):
                for row in rows[inside].tolist():
                    found[row].append(number)
        return pd.Series([np.array(f, np.int32) for f in found])

    return parts


def _tile_links(distinct: DataFrame, spec: ForestFit) -> DataFrame:
    """``(node, links, least)`` by tile: the links of a vector counted there, by weight, and the smallest node reached."""
    session = distinct.sparkSession
    v = F.col("vector")
    sizes = {r.dims: r.n for r in distinct.groupBy(F.size(v).alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}
    forests, leaves = {}, 0
    for dims, n in sorted(sizes.items()):
        sample = distinct.where(F.size(v) == dims).where(hash_share("vector") < min(1.0, spec.sample / n)).select("vector").collect()
        x = np.array(sorted(r.vector for r in sample), dtype=float).reshape(-1, dims)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        trees = [fit_tree(x, n / max(1, len(x)), spec, spec.seed * 1000 + t) for t in range(spec.trees)]
        # One leaf is the whole table: more trees would compare it again.
        trees = trees if len(trees[0].child) > 1 else trees[:1]
        forests[dims] = (leaves, trees)
        leaves += sum(int((tree.child[:, 0] < 0).sum()) for tree in trees)
    handle = session.sparkContext.broadcast(forests)

    @F.pandas_udf("array<long>")
    def leaves_of(vectors: pd.Series) -> pd.Series:
        found = [[] for _ in range(len(vectors))]
        sizes = vectors.map(len).to_numpy()
        for dims in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dims)
            x = np.stack(vectors.iloc[rows].tolist()).astype(float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            first, trees = handle.value[dims]
            for tree in trees:
                for leaf, inside in tree.leaves(x, margin_of(spec, dims)):
                    for row in rows[inside].tolist():
                        found[row].append(first + leaf)
                first += int((tree.child[:, 0] < 0).sum())
        return pd.Series([np.unique(np.array(f, np.int64)) for f in found])

    marked = refined(durable(distinct.select("node", "weight", "vector", leaves_of("vector").alias("marks"))), spec)
    inside = marked.select("node", "weight", "vector", "marks", F.explode("marks").alias("leaf"))
    tiles = durable(leaf_sizes(marked).select("leaf", F.ceil(F.col("n") / spec.tile).cast("int").alias("tiles")))
    work = tiles.agg(F.sum(F.col("tiles") * (F.col("tiles") + 1) / 2)).first()[0]
    if not work:
        return session.createDataFrame([], "node long, links long, least long")
    dealt = (
        inside.join(hinted(tiles, is_small(tiles, SearchOptions(), F.lit(16))), "leaf")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("pair", F.struct("leaf", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")))
    )
    cosine = spec.cosine

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        tile, other = pdf["tile"].to_numpy(), pdf["other"].to_numpy()
        x = np.stack(pdf["vector"].tolist()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        low = tile == min(tile.min(), other.min())
        apart = int(tile[0]) != int(other[0])
        left = np.flatnonzero(low)
        right = np.flatnonzero(~low) if apart else left
        nodes, links, least = link_tile(
            pdf["node"].to_numpy(), x, pdf["weight"].to_numpy(), pdf["marks"].tolist(), int(pdf["leaf"].iloc[0]), left, right, cosine)
        return pd.DataFrame({"node": nodes, "links": links, "least": least})

    return (
        dealt.repartition(max(1, min(MOST_TASKS, ceil(work / 2))), "pair").groupBy("pair")
        .applyInPandas(compare, "node long, links long, least long")
    )
