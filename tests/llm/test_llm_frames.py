"""The helpers that operators share."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from codelantern.llm import frames


def test_most_frequent_keys(spark):
    rows = [(n, f"k{i}", 1000 // (i + 1)) for n in (0, 1) for i in range(900)] + [(0, "x", None)]
    counts = spark.createDataFrame(rows, "n int, key string, times long").where("times is not null")
    got = frames.most_frequent(counts, "key", "times", {0: 20, 1: 5000}, "n").collect()
    first = {r.key for r in got if r.n == 0}
    assert 12 <= len(first) <= 30 and {f"k{i}" for i in range(12)} <= first
    assert len([r for r in got if r.n == 1]) == 900
    flat = spark.range(10_000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("times"))
    assert 350 < frames.most_frequent(flat, "key", "times", {0: 500}).count() < 650
    assert frames.most_frequent(flat.where("false"), "key", "times", {0: 500}).count() == 0


def test_added_columns_replace_and_keep(spark):
    df = spark.createDataFrame([(i, f"t{i}", "old", 1) for i in range(600)], "id int, text string, size string, input0 int")
    got = frames.add_columns(df, [F.upper("text"), "text"], lambda a, b: [pa.array([x.as_py() + y.as_py() for x, y in zip(a, b, strict=True)])], "size string")
    assert got.columns == ["id", "text", "input0", "size"]
    assert sorted((r.id, r.size, r.input0) for r in got.collect()) == [(i, f"T{i}t{i}", 1) for i in range(600)]
    assert got.where("false").collect() == []


def test_stretches_join_to_the_text():
    cut = re.compile(" ")
    for text in ("", "a", "ab cd ef gh", "abcdefghijk", " " * 9):
        found = list(frames.stretches(text, cut, 3))
        assert "".join(found) == text and all(s.startswith(" ") for s in found[1:])
