"""Small helpers that the operators share: Arrow batches, bounded slices, and names that cannot clash."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelantern.operators.sizing import durable

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of at most ``SLICE_ROWS`` rows, so that long texts stay few in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(start, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def stretches(text: str, cut: re.Pattern, size: int) -> Iterator[str]:
    """``text`` in stretches of at least ``size`` characters, each but the first beginning with a match of ``cut``."""
    at = 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:] if at else text


def add_columns(df: DataFrame, inputs: list[str | Column], work: Callable[..., list[pa.Array]], added: str) -> DataFrame:
    """All columns of ``df`` and those that ``work`` makes of the inputs' slices; columns of the ``added`` names are replaced.

    Results leave a task slice by slice, so its memory is one batch of rows and one slice of results.
    """
    new = T.StructType.fromDDL(added)
    kept = [c for c in df.columns if c not in new.names]
    extra = {i: unused(df, f"input{i}") for i, c in enumerate(inputs) if not (isinstance(c, str) and c in kept)}
    source = df.select(*(F.col(f"`{c}`") for c in kept), *(
        (F.col(inputs[i]) if isinstance(inputs[i], str) else inputs[i]).alias(name) for i, name in extra.items()))
    at = [source.columns.index(extra.get(i, c)) for i, c in enumerate(inputs)]
    names = [*kept, *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = batch.slice(start, SLICE_ROWS).columns
                yield pa.RecordBatch.from_arrays([*columns[:len(kept)], *work(*(columns[i] for i in at))], names)

    return source.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), *new.fields]))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added the first such name that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def most_frequent(counts: DataFrame, key: str, times: str, most: dict[int, int], group: str | None = None) -> DataFrame:
    """The rows of ``counts`` with the most frequent keys, about ``most[g]`` of each group ``g`` (without groups: 0).

    Counts are put on a logarithmic scale and the sizes of its steps alone reach the
    driver, so nothing is sorted.  Of the step that does not fit whole, a part fixed by a
    hash of the key is taken.
    """
    step = F.floor(F.log2(times) * 16).cast("int")
    rows = durable(counts.select("*", step.alias("step"), (F.col(group) if group else F.lit(0)).alias("part")))
    steps = rows.groupBy("part", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    keep = F.lit(False)
    for part, room in most.items():
        kept = F.lit(True)
        for found in sorted((s for s in steps if s.part == part), key=lambda s: -s.step):
            if found.n > room:
                kept = (F.col("step") > found.step) | ((F.col("step") == found.step) & (hash_share(key) < room / found.n))
                break
            room -= found.n
        keep = F.when(F.col("part") == part, kept).otherwise(keep)
    return rows.where(keep).drop("step", "part")


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """True for the rows whose crc32 of the id, as text, falls in ``fold``; a null id is in no fold."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % folds
    return F.coalesce(remainder == fold, F.lit(False))


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) fixed by the columns: rows below a share of it are a sample that any run repeats."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / F.lit(float(1 << 31))
