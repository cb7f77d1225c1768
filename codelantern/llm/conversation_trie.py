"""The prefix tree of conversations, from double-array tries of its shards.

Conversations become strands: runs of a few dozen turns, each turn known by two
hashes.  Strands are sorted by the prefix that they start at and by their first
turns, and each stretch of the sorted rows is a shard: a trie packed into BASE and
CHECK arrays over the shard's dense turn ids, which its strands traverse.  A node is
named by its depth and by two sums of hashes of all turns above it, so the nodes that
shards have in common are merged by name: upper nodes, and any prefix so frequent
that it fills several shards.

Sums over subtrees need no climbing: the nodes whose smallest member is c
lie at the bottom of c's path.  A subtree's sum is what its members own in
all, less what its own smallest member owns above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelantern.config import SearchOptions
from codelantern.operators.sizing import durable, is_small

NODE = ["depth", "x", "y"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieSpec:
    strand_turns: int = 64      #: turns of a strand at most, but for the shared turns before the first
    shard_strands: int = 2048   #: strands of a shard at most
    sum_depths: int = 1024      #: depths of one conversation summed at a time
    wide: int = 10_000          #: children from which a parent is told to them by broadcast, if all such parents are measured small


@dataclass(frozen=True)
class Branches:
    """Conversations that share turns: of conversation c the first ``shared(c)`` turns are those of ``origin(c)``."""

    shared: Callable[[Column], Column]
    origin: Callable[[Column], Column]
    most: int                   #: no conversation shares more turns


# -- a shard's trie ----------------------------------------------------------------------------
class DoubleArray:
    """A trie over codes from 1: the child of slot s by code c is slot ``base[s] + c`` if ``check`` there says s."""

    def __init__(self, ptr: np.ndarray, codes: np.ndarray):
        """Holds all sequences ``codes[ptr[i]:ptr[i + 1]]``; slot 0 is the root."""
        self.top = int(codes.max(initial=0))
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1, np.int64)
        self.used, self.high, self.low = np.ones(1, bool), 1, 1
        sizes, slot = np.diff(ptr), np.zeros(len(ptr) - 1, np.int64)
        live = np.flatnonzero(sizes > 0)
        for level in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > level]
            pair, back = np.unique(slot[live] * (self.top + 1) + codes[ptr[live] + level], return_inverse=True)
            slot[live] = self._children(pair // (self.top + 1), pair % (self.top + 1))[back]

    def _room(self, until: int) -> None:
        if until > len(self.used):
            more = max(until, 2 * len(self.used)) - len(self.used)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
            self.used = np.append(self.used, np.zeros(more, bool))

    def _children(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Slots for the children of a level, given by ascending parent and code."""
        found = np.empty(len(parent), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        sizes = np.diff(np.append(starts, len(parent)))
        for start, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            codes = code[start:start + size]
            found[start:start + size] = slots = self._fit(codes) + codes
            self.used[slots] = True
            self.high = max(self.high, int(slots[-1]) + 1)
        single = starts[sizes == 1]
        self._room(self.high + len(single))
        free = np.flatnonzero(~self.used[self.low:self.high + len(single)])[:len(single)] + self.low
        found[single] = free
        self.used[free] = True
        if len(free):
            self.high, self.low = max(self.high, int(free[-1]) + 1), int(free[-1]) + 1
        self.base[parent[starts]] = found[starts] - code[starts]
        self.check[found] = parent
        return found

    def _fit(self, codes: np.ndarray) -> int:
        """A base under which all codes find free slots: at one of the first holes, else beyond all that is used."""
        self._room(self.high + self.top + 1)
        for hole in np.flatnonzero(~self.used[self.low:min(self.high, self.low + 1024)])[:8] + self.low:
            if not self.used[hole - codes[0] + codes].any():
                return hole - codes[0]
        return self.high - codes[0]

    def step(self, slot: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The children of slots by codes, -1 where there is none."""
        at = self.base[slot] + code
        good = (at > 0) & (at < len(self.check))
        good[good] = self.check[at[good]] == slot[good]
        return np.where(good, at, -1)


@dataclass
class Strands:
    """The strands of a shard: where they start, their turns, whom they belong to and what they bring to each node."""

    conv: np.ndarray
    opens: np.ndarray           # the conversation's first strand, which counts for the root
    depth: np.ndarray
    root: np.ndarray            # (strand, 2): the name of the node above the first turn
    ptr: np.ndarray
    turn: np.ndarray            # (turn, 2): hashes of the turn
    hashed: np.ndarray          # (turn, 2): hashes of turn and depth
    chars: np.ndarray
    gifts: np.ndarray           # (strand, n): summed over the members of each node


def shard_nodes(s: Strands) -> pa.RecordBatch:
    """Every node that the strands reach below their starts, and the root for conversations that start here."""
    sizes = np.diff(s.ptr)
    turns, code = np.unique(s.turn, axis=0, return_inverse=True)
    starts, start_code = np.unique(np.column_stack([s.depth.astype(np.int64), s.root]), axis=0, return_inverse=True)
    # Each sequence begins with the number of its start, beyond the codes of turns.
    ptr = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.empty(ptr[-1], np.int64)
    firsts = np.zeros(len(codes), bool)
    firsts[ptr[:-1]] = True
    codes[firsts], codes[~firsts] = start_code.ravel() + len(turns) + 1, code.ravel() + 1
    trie = DoubleArray(ptr, codes)

    slot, name = trie.step(np.zeros(len(sizes), np.int64), codes[ptr[:-1]]), s.root.copy()
    live = np.arange(len(sizes))
    opening = np.flatnonzero(s.opens)
    none = np.zeros((len(opening), 2), np.int64)
    visits = [(slot[opening], opening, s.depth[opening], name[opening], none, np.zeros(len(opening), np.int64))]
    for level in range(int(sizes.max(initial=0))):
        live = live[sizes[live] > level]
        at = s.ptr[live] + level
        slot[live] = trie.step(slot[live], codes[ptr[live] + level + 1])
        above = name[live]
        name[live] = above ^ s.hashed[at]
        visits.append((slot[live], live, s.depth[live] + level + 1, name[live], above, s.chars[at]))
    slots, strand, depth, name, above, chars = (np.concatenate(v) for v in zip(*visits, strict=True))
    found, first, back = np.unique(slots, return_index=True, return_inverse=True)
    least = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(least, back, s.conv[strand])
    gifts = np.zeros((len(found), s.gifts.shape[1]), np.int64)
    np.add.at(gifts, back, s.gifts[strand])
    columns = [depth[first], *name[first].T, *above[first].T, chars[first], np.bincount(back, minlength=len(found)), least, *gifts.T]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=[
        *NODE, "above_x", "above_y", "chars", "n", "conv", *(f"gift{i}" for i in range(gifts.shape[1]))])


def _pairs(column: pa.Array) -> np.ndarray:
    return np.column_stack([column.field(i).to_numpy(zero_copy_only=False) for i in range(2)])


def _node_parts(strands: DataFrame, gifts: list[str], spec: TrieSpec) -> DataFrame:
    """The nodes of all shards, each with its members there: count, smallest id and sums of the gifts."""
    order = ["depth0", "root.x", "root.y", F.get("turns", F.lit(0)), F.get("turns", F.lit(1)), F.get("turns", F.lit(2)), "conv", "start"]
    # Sorted, copies of a conversation and its relatives lie side by side; a prefix shared by all may span shards.
    dealt = strands.select("conv", "opens", "depth0", "root", "turns", "hashed", "chars", "start", *gifts)
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, spec.shard_strands):
                b = batch.slice(at, spec.shard_strands)
                ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("turns")).to_numpy())]).astype(np.int64)
                number = lambda name: b.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                yield shard_nodes(Strands(
                    number("conv"), number("opens"), number("depth0"), _pairs(b.column("root")), ptr, _pairs(b.column("turns").flatten()),
                    _pairs(b.column("hashed").flatten()), b.column("chars").flatten().to_numpy(),
                    np.column_stack([number(g) for g in gifts]) if gifts else np.zeros((b.num_rows, 0), np.int64)))

    names = [*NODE, "above_x", "above_y", "chars", "n", "conv", *(f"gift{i}" for i in range(len(gifts)))]
    return dealt.mapInArrow(nodes, ", ".join(f"{n} long" for n in names))


# -- from turns to strands ---------------------------------------------------------------------
def _runs(turns: DataFrame, size: int) -> DataFrame:
    """``(conv, part, at, x, y, chars)``: runs of at most ``size`` turns; ``at`` turns of the conversation lie before it in its part."""
    order = ["conv", "turn", "role", "text"]
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(1), "text", "role").alias("y"), F.char_length("text").cast("long").alias("chars"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            ends = np.append(heads[1:], len(conv))
            before = np.zeros(len(heads), np.int64)
            if conv[0] == last:
                before[0] = done
            last, done = conv[-1], int(before[-1] + ends[-1] - heads[-1])
            many = -(-(ends - heads) // size)
            owner = np.repeat(np.arange(len(heads)), many)
            at = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * size
            offsets = pa.array(np.append(heads[owner] + at, len(conv)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(conv[heads[owner]]), pa.array(np.full(len(owner), part, np.int64)), pa.array(before[owner] + at),
                *(pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("x", "y", "chars"))],
                names=["conv", "part", "at", "x", "y", "chars"])

    return placed.mapInArrow(cut, "conv long, part long, at long, x array<long>, y array<long>, chars array<long>")


def _strands(turns: DataFrame, spec: TrieSpec, branches: Branches | None) -> DataFrame:
    """``(conv, part, start, opens, depth0, root, turns, hashed, chars, ends)``, stored.

    No step holds a whole conversation: a conversation's parts (one per task of the sort) are joined and summed by part.
    """
    runs = durable(_runs(turns, spec.strand_turns))
    conv = F.col("conv")
    in_conv = Window.partitionBy("conv")
    earlier = in_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = runs.groupBy("conv", "part").agg(F.sum(F.size("x")).alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(in_conv).alias("total"))
    turn = F.transform(F.arrays_zip("x", "y", "chars"), lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), t["chars"].alias("chars")))
    no_turns = F.array().cast("array<struct<x: bigint, y: bigint, chars: bigint>>")
    if branches is None:
        parts = parts.select("*", F.lit(0).alias("h"), no_turns.alias("head"))
    else:
        wanted = parts.select(branches.origin(conv).alias("conv")).distinct()
        near = runs.join(parts, ["conv", "part"]).withColumn("from", F.col("before") + F.col("at")).where(F.col("from") < branches.most)
        heads = near.join(wanted, "conv", "left_semi").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("from", turn.alias("turns")))).alias("runs"))
        heads = heads.select(F.col("conv").alias("origin"), F.slice(F.flatten("runs.turns"), 1, branches.most).alias("first"))
        parts = parts.select("*", branches.shared(conv).cast("int").alias("h"), branches.origin(conv).alias("origin")).join(heads, "origin", "left")
        parts = parts.select("conv", "part", "before", "total", "h", F.when(F.col("h") > 0, F.slice("first", 1, F.col("h"))).alias("head"))
        parts = parts.withColumn("head", F.coalesce("head", no_turns))
    joined = runs.join(parts, ["conv", "part"]).select(
        "conv", "part", (F.col("before") + F.col("at")).alias("start"), turn.alias("own"), F.size("x").alias("size"), "total", "h", "head")
    skipped = F.greatest(F.lit(0), F.least(F.col("h") - F.col("start"), "size")).cast("int")
    opens = F.col("start") == 0
    shaped = joined.select(
        "conv", "part", "start", opens.alias("opens"), (F.col("start") + F.col("size") == F.col("total")).alias("ends"),
        F.when(opens, 0).otherwise(F.size("head") + F.greatest("start", "h") - F.col("h")).cast("long").alias("depth0"),
        F.concat(F.when(opens, F.col("head")).otherwise(no_turns), F.slice("own", skipped + 1, F.col("size"))).alias("turn"))
    depth = lambda i: F.col("depth0") + i + 1
    hashed = shaped.withColumn("hashed", F.transform("turn", lambda t, i: F.struct(
        F.xxhash64(depth(i), t["x"], t["y"]).alias("x"), F.xxhash64(t["y"], t["x"], depth(i), F.lit(2)).alias("y"))))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    hashed = durable(hashed.withColumn("sum", F.reduce("hashed", zero, lambda s, h: F.struct(
        s["x"].bitwiseXOR(h["x"]).alias("x"), s["y"].bitwiseXOR(h["y"]).alias("y")))))
    # Names of the strands' starts: sums inside a part, then of the parts before it.
    inside = Window.partitionBy("conv", "part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv", "part").agg(F.bit_xor("sum.x").alias("x"), F.bit_xor("sum.y").alias("y"))
    sums = sums.select("conv", "part", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in "xy"))
    name = F.struct(*(F.coalesce(F.bit_xor(f"sum.{c}").over(inside), F.lit(0)).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in "xy"))
    return durable(hashed.join(sums, ["conv", "part"]).select(
        "conv", "part", "start", "opens", "ends", "depth0", name.alias("root"), "sum",
        F.transform("turn", lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"))).alias("turns"), "hashed",
        F.transform("turn", lambda t: t["chars"]).alias("chars")))


# -- what conversations end where --------------------------------------------------------------
def _end_digests(strands: DataFrame) -> DataFrame:
    """``(depth, x, y, ends)``: SHA-256 of the ascending ids that end at a node, joined by commas.

    Tasks of a global order join ids to texts, so that the one reader whom a digest needs sees few rows per node.
    """
    ends = strands.where("ends").select(
        (F.col("depth0") + F.size("turns")).alias("depth"), F.col("root.x").bitwiseXOR(F.col("sum.x")).alias("x"),
        F.col("root.y").bitwiseXOR(F.col("sum.y")).alias("y"), "conv")
    order = [*NODE, "conv"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = [batch.column(c).to_numpy() for c in NODE]
                change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
                heads = np.flatnonzero(np.concatenate([[True], change]))
                texts = pa.ListArray.from_arrays(
                    pa.array(np.append(heads, batch.num_rows).astype(np.int32)), batch.column("conv").cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(heads)) for c in order), pc.binary_join(texts, ",")], names=[*order, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if here != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, state.hexdigest())])

    node = "depth long, x long, y long"
    texts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{node}, conv long, ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(digest, f"{node}, ends string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), r, strict=True)) for r in rows], schema=pa.schema(
        [*((c, pa.int64()) for c in NODE), ("ends", pa.string())]))


# -- the tree ----------------------------------------------------------------------------------
def _with_parents(nodes: DataFrame, spec: TrieSpec) -> DataFrame:
    """Adds ``parent_conv``.  A parent with very many children would be one join key, so such parents are broadcast if measured small."""
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("above_x"), F.col("y").alias("above_y"),
                           F.col("conv").alias("parent_conv"), "n_children")
    above = ["depth", "above_x", "above_y"]
    wide = parents.where(F.col("n_children") >= spec.wide).drop("n_children")
    if not is_small(wide, SearchOptions(), F.lit(32)):
        return nodes.join(parents.drop("n_children"), above, "left")
    marked = nodes.join(F.broadcast(wide), above, "left")
    rest = marked.where("parent_conv is null").drop("parent_conv").join(
        parents.where(F.col("n_children") < spec.wide).drop("n_children"), above, "left")
    return marked.where("parent_conv is not null").unionByName(rest)


def conversation_trie(turns: DataFrame, spec: TrieSpec = TrieSpec(), branches: Branches | None = None) -> DataFrame:
    """One row per distinct beginning of the conversations in ``turns(conv_id, turn, role, text)``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the smallest
    conversation with this beginning and that of its parent (null for the root), members, children,
    childless nodes of the subtree, code points that the subtree need not repeat, and a
    digest of the conversations that end here.  Turns are ordered by turn (null first), then role, then text;
    repeated rows are turns of their own; null roles and texts are empty; rows without a
    conv_id are left out, as are other columns.  An empty table gives no node.
    """
    strands = _strands(turns, spec, branches)
    merged = _node_parts(strands, [], spec).groupBy(*NODE).agg(
        F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), F.min("above_x").alias("above_x"), F.min("above_y").alias("above_y"),
        F.min("chars").alias("chars"))
    merged = durable(merged)
    children = merged.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("above_x").alias("x"), F.col("above_y").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = durable(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))

    owned = ["leaf", "saved"]
    band = F.floor(F.col("depth") / spec.sum_depths).alias("band")
    above = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = nodes.groupBy("conv", band).agg(*(F.sum(c).alias(c) for c in owned))
    bands = durable(bands.select("conv", "band", *owned, *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in owned)))
    inside = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("band", band).join(bands.drop(*owned), ["conv", "band"])
    nodes = nodes.select("*", *((F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_above") for c in owned))

    totals = bands.groupBy("conv").agg(*(F.sum(c).alias(c) for c in owned))
    gifts = strands.select("conv", "part").distinct().join(totals, "conv", "left").select(
        "conv", "part", *(F.coalesce(c, F.lit(0)).alias(c) for c in owned))
    sums = _node_parts(strands.join(gifts, ["conv", "part"]), owned, spec).groupBy(*NODE).agg(
        *(F.sum(f"gift{i}").alias(f"{c}_all") for i, c in enumerate(owned)))
    found = _with_parents(durable(nodes), spec).join(sums, NODE).join(_end_digests(strands), NODE, "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf_all") - F.col("leaf_above")).alias("n_leaves"), (F.col("saved_all") - F.col("saved_above")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
