"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate that moves its share of all text to its
target.  A hash of the document is read as a uniform number and put through the
inverse of the Poisson distribution with that mean, which gives the number of
its copies without any state; copies are then shuffled globally.  A large mean is
dealt as the sum of several small ones, each with a number of its own, so no target is out of reach.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from math import inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern.operators.sizing import durable

#: Sources up to which the table of rates is sent to all tasks (about 1.5 KB each).
SENT_SOURCES = 10_000
#: Mean of one Poisson draw at most; larger rates are sums of equal draws.
DRAWN_MEAN = 64.0

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Mix:
    weights: dict[str, float] = field(default_factory=dict)  #: target shares of named sources; others get none
    flatten: float = 0.5      #: without weights, targets follow the sources' shares to this power
    epochs: float = 1.0       #: size of the result, in sizes of the input
    most: float = inf         #: mean repetition rate at most; what it takes from a source goes to the others
    seed: int = 7


def hashed_number(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, as a long."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def poisson_bounds(rate: Column, most: float) -> Column:
    """The distribution function of the Poisson with mean ``rate`` at 0, 1, 2, ... far into the tail of ``most``."""
    ends = int(most + 12 * most ** 0.5 + 20)
    zero = F.exp(-rate)
    start = F.struct(zero.alias("p"), zero.alias("below"), F.array(zero).alias("bounds"))

    def step(state: Column, k: Column) -> Column:
        p = state.p * rate / k
        return F.struct(p.alias("p"), (state.below + p).alias("below"), F.array_append(state.bounds, state.below + p).alias("bounds"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ends)), start, step, lambda state: state.bounds)


def repetition_rates(docs: DataFrame, spec: Mix, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, size, rate, target, reached)`` by source, a null source being one; sizes are bytes of text.

    ``target`` and ``reached`` are shares of the mixture.  They differ only where ``most`` holds a source
    back; then the others are scaled up until the total is ``epochs``, as far as ``most`` lets them.
    Sources without any text have the rate 1.  If no source has a weight, nothing is repeated.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.octet_length(F.coalesce(text_col, F.lit("")))).cast("double").alias("size"))
    if spec.weights:
        weight = F.lit(0.0)
        for name, share in spec.weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(share))).otherwise(weight)
    else:
        weight = F.pow("size", F.lit(spec.flatten))
    sizes = durable(sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0))))
    size, weights = sizes.where("size > 0").agg(F.sum("size"), F.sum("weight")).first()
    goal = spec.epochs * (size or 0.0)
    scale, capped = goal / (weights or 1.0), 0
    while spec.most < inf:
        over = F.col("weight") * F.lit(scale) > F.lit(spec.most) * F.col("size")
        found = sizes.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("size"))).alias("size"),
                          F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if found.n == capped:
            break
        capped = found.n
        if not found.free:
            break
        scale = (goal - spec.most * found["size"]) / found.free
    if capped:
        _log.warning("%d sources stay below their target shares, since they are repeated %g times at most", capped, spec.most)
    wanted = F.col("weight") * F.lit(scale) / F.col("size")
    rate = F.when(F.col("size") > 0, F.least(F.lit(spec.most), wanted)).otherwise(F.lit(1.0))
    rates = sizes.withColumn("rate", rate)
    mixed = rates.agg(F.sum(F.col("rate") * F.col("size"))).first()[0] or 1.0
    return rates.select(
        "source", "size", "rate", (F.col("weight") / F.lit(weights or 1.0)).alias("target"),
        (F.col("rate") * F.col("size") / F.lit(mixed)).alias("reached"))


def mix_sources(docs: DataFrame, spec: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, once for each copy, with ``copy`` (from 0) and ``shuffle_key``, dealt by that key and sorted by it in each part.

    A document's number of copies depends on seed and id (without id: on its
    text), so repeated rows are copied alike.  Columns with the two added names are replaced.  A
    null source is a source, a null text has no size, an empty table gives an empty result.
    """
    rates = repetition_rates(docs, spec, source_col, text_col)
    few = rates.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES
    # The document travels as one struct, so that no column of it can meet one of the names used here.
    draws = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / DRAWN_MEAN)).cast("int")
    rates = rates.withColumn("draws", draws).select(
        F.struct("source").alias("from"), "draws", poisson_bounds(F.col("rate") / F.col("draws"), min(spec.most, DRAWN_MEAN)).alias("bounds"))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), F.struct(F.col(source_col).alias("source")).alias("from"), key.alias("key"))
    joined = rows.join(F.broadcast(rates) if few else rates, "from")
    def copies(*more: Column) -> Column:
        uniform = hashed_number(F.lit(str(spec.seed)), F.col("key"), *more) / F.lit(float(1 << 52))
        return F.size(F.filter("bounds", lambda b: b <= uniform))

    rest = F.aggregate(
        F.sequence(F.lit(1), F.col("draws") - 1), F.lit(0), lambda n, k: n + copies(F.concat(F.lit("draw "), k.cast("string"))))
    drawn = joined.withColumn("copies", copies() + F.when(F.col("draws") > 1, rest).otherwise(F.lit(0)))
    dealt = drawn.where("copies > 0").select("doc", "key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    order = hashed_number(F.lit(f"{spec.seed} order"), F.col("key"), F.col("copy").cast("string"))
    return (
        dealt.select(*(F.col(f"doc.`{c}`") for c in kept), "copy", order.alias("shuffle_key"))
        .repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    )
