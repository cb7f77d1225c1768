"""Connected components of a link table, by alternating large-star and small-star steps.

Both steps are joins against one minimum per node, so a node with very many
links is a skewed join that Spark splits, never a collected neighbourhood.
Each round is stored in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern.operators.sizing import durable

#: Rounds after which the labels of any graph of up to 2^60 nodes are final, by the method's bound.
MAX_ROUNDS = 60


def spanning_stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the links (left[i], right[i])."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least"))
    return (
        both.join(least, "src").where(F.col("dst") > F.col("src"))
        .select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("least"))
    moved = down.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).where("src <> dst")
    return moved.unionByName(least.withColumnRenamed("least", "dst")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.min("src"), F.max("dst")).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(src, dst)``; the component is the smallest node reached.

    Links of a node with itself and repeated links count once; null ends are
    dropped.  No links give an empty result.
    """
    links = links.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    now = durable(links.where("src <> dst").distinct())
    before, state = None, _state(now)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0 or state == before:
            break
        now = durable(_small_star(_large_star(now)))
        before, state = state, _state(now)
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
