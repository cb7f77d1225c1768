"""Near copies by the exact similarity of shingle sets; wide SimHash fingerprints only search for candidates.

Texts with one set of shingles are one node.  The tiles of ``simhash`` join
nodes whose fingerprints are near, which gives candidate groups.  Within a group
the sets themselves are compared, and only pairs that share enough link.  Large groups are cut into
blocks, and every two blocks go to one task, which returns stars and never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern.llm.components import components
from codelantern.llm.frames import map_slices
from codelantern.llm.simhash import SimHash, near_links, packed, shingle_set
from codelantern.operators.sizing import durable


@dataclass(frozen=True)
class NearCopies:
    prints: SimHash           #: fingerprints and the radius of the candidate search
    share: float = 0.8        #: least Jaccard similarity of two shingle sets that link
    block: int = 256          #: sets of a candidate group that are compared as one block
    block_shingles: int = 1 << 21  #: shingles of a block, about


def similar_groups(sets: list[np.ndarray], share: float) -> np.ndarray:
    """For each of some sets, none of them empty, the first set that it reaches over links of at least ``share``.

    A set is held against those only that nothing has reached yet, so a group of copies takes about one pass.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    begins = np.cumsum(sizes) - sizes
    label, marks = np.full(len(sets), -1), np.zeros(flat.max() + 1, np.int32)
    rows, held, starts = np.arange(len(sets)), flat, begins
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        while queue:
            at = queue.pop()
            left = label[rows] < 0
            if not left.any():
                break
            if 2 * left.sum() < len(rows):
                held = held[np.repeat(left, sizes[rows])]
                rows = rows[left]
                starts = np.cumsum(sizes[rows]) - sizes[rows]
            own = flat[begins[at]:begins[at] + sizes[at]]
            marks[own] = 1
            shared = np.add.reduceat(marks[held], starts)
            marks[own] = 0
            found = rows[(label[rows] < 0) & (shared + 1e-9 >= share * (sizes[rows] + sizes[at] - shared))]
            label[found] = first
            queue += found.tolist()
    return label


def _set_rows(docs: DataFrame, spec: SimHash, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_key, set_hash, n, f0, ...)`` for every row of ``docs``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(text, spec) for text in batch.column(2).to_pylist()]
        prints = [packed([one], spec) for one in found]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(one.tobytes()) for one in found], pa.binary()),
             pa.array(list(map(len, found)), pa.int64()), *(pa.array([row[k] for row in prints], pa.int64()) for k in range(len(spec.columns)))],
            ["id", "text_key", "set_hash", "n", *spec.columns])

    schema = "id long, text_key long, set_hash binary, n long, " + ", ".join(f"{c} long" for c in spec.columns)
    return map_slices(docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")), work, schema)


def _similar_links(docs: DataFrame, chosen: DataFrame, spec: NearCopies, id_col: str, text_col: str) -> DataFrame:
    """Stars ``(src, dst)`` of the nodes in ``chosen(id, text_key, node, n, component)`` that are similar."""
    prints = spec.prints

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(text, prints).tobytes() for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    sets = map_slices(
        texts.join(chosen.select("id", "text_key", "node"), ["id", "text_key"]).select("node", "text"), work, "node long, shingles binary")
    sizes = chosen.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / spec.block, F.col("shingles") / spec.block_shingles)).cast("int")
    plan = durable(sizes.select("component", blocks.alias("blocks")).join(chosen.select("component", "node", "n"), "component"))
    small = plan.where("blocks = 1").agg(F.count(F.lit(1)), F.sum("n")).first()
    baskets = max(1, -(-small[0] // spec.block), -(-(small[1] or 0) // spec.block_shingles))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("own"))
    placed = plan.withColumn("own", own).select(
        "component", "node", "own",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(baskets))).otherwise(F.col("component")).alias("place"),
        F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(-1))).otherwise(others)).alias("other"))
    placed = placed.select(
        "component", "node", "place", F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.least("own", "other")).alias("low"),
        F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.greatest("own", "other")).alias("high"))
    share = spec.share

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Rows of one id and text bring their set more than once.
        for _, part in pdf.drop_duplicates("node").sort_values("node").groupby("component"):
            nodes = part["node"].to_numpy()
            label = similar_groups([np.frombuffer(one, np.uint64) for one in part["shingles"]], share)
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            src.append(nodes[moved])
            dst.append(nodes[label[moved]])
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return durable(placed.join(sets, "node").groupBy("place", "low", "high").applyInPandas(compare, "src long, dst long"))


def near_copy_groups(docs: DataFrame, spec: NearCopies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, n_rows, group)`` for each id and text: the number of the group of near copies that it is in.

    ``text_key`` is the xxhash64 of the text.  Texts without words are one group.  Rows without an id are left out.
    """
    prints = spec.prints
    rows = durable(_set_rows(docs.where(F.col(id_col).isNotNull()), prints, id_col, text_col))
    nodes = durable(
        rows.groupBy("set_hash", "n", *prints.columns).agg(F.min(F.struct("id", "text_key")).alias("first"))
        .withColumn("node", F.monotonically_increasing_id()))
    near = components(near_links(nodes.where("n > 0").select("node", *prints.columns), prints))
    chosen = durable(near.join(nodes, "node").select("first.id", "first.text_key", "node", "n", "component"))
    alike = components(_similar_links(docs, chosen, spec, id_col, text_col))
    label = nodes.join(alike, "node", "left").select("set_hash", F.coalesce("component", "node").alias("group"))
    per_text = rows.groupBy("id", "text_key", "set_hash").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_text.join(label, "set_hash").select("id", "text_key", "n_rows", "group")


def first_copies(docs: DataFrame, spec: NearCopies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group of near copies, and the rows without an id.

    The row has the group's smallest id, of those the smallest text (null first), and of rows
    equal in both the one with the smallest hash of all columns.
    """
    groups = durable(near_copy_groups(docs, spec, id_col, text_col))
    least = groups.groupBy("group").agg(F.min("id").alias("id"))
    firsts = durable(groups.join(least, ["group", "id"]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    several = firsts.groupBy("group").agg(F.count(F.lit(1)).alias("unlike")).where("unlike > 1")
    told = firsts.join(several, "group")
    if not told.isEmpty():
        smallest = texts.join(told.select("id", "text_key", "group"), ["id", "text_key"]).groupBy("group").agg(
            F.min(F.struct("text", "text_key")).alias("smallest"))
        firsts = durable(firsts.join(smallest, "group", "left").where("smallest is null or smallest.text_key = text_key").drop("smallest"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # The document travels as one struct, so that no column of it can meet one of the names used here.
    rows = docs.select(F.struct(*columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"))
    kept = rows.join(firsts.select("id", "text_key", "n_rows"), ["id", "text_key"], "left").where("id is null or n_rows is not null")
    found = kept.where("id is null or n_rows = 1").select("doc")
    if not firsts.where("n_rows > 1").isEmpty():
        once = kept.where("n_rows > 1").groupBy("id", "text_key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        found = found.unionByName(once.select("doc"))
    return found.select(*(F.col(f"doc.`{c}`") for c in docs.columns))
