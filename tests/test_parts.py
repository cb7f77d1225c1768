"""Batches are counted in rows; what a task makes of one is bounded by its values."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from codelantern.operators import chunking
from codelantern.operators.blocks import in_parts
from codelantern.operators.embedding import unit_sums
from codelantern.operators.lexical import LexicalIndex, bm25_search, query_tokens, summarized, wanted_tokens


def _peak_mb(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2**20


def _lists(sizes, values):
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("int32")), values)


def test_parts_hold_all_rows_in_order_and_few_values():
    lists = pa.array([[1, 2], None, [], [3] * 9, [4], [5, 6]])
    batch = pa.RecordBatch.from_arrays([lists, pa.array(range(6))], ["v", "n"])
    assert [p.column(1).to_pylist() for p in in_parts(batch, "v", values=4)] == [[0, 1, 2], [3], [4, 5]]
    assert [p.column(1).to_pylist() for p in in_parts(batch, "v", np.array([0, 2, 4]), values=10)] == [[0, 1], [2, 3], [4, 5]]
    assert list(in_parts(batch.slice(0, 0), "v")) == []


def test_embedding_memory_does_not_follow_the_batch():
    rng = np.random.default_rng(1)
    slots = _lists([20_000] * 150, pa.array(rng.integers(0, 128, 3_000_000).astype("int32")))
    assert _peak_mb(lambda: unit_sums(slots, 64)) < 40
    assert unit_sums(slots, 64).slice(149).to_pylist() == unit_sums(slots.slice(149), 64).to_pylist()
    assert unit_sums(pa.array([[], None, [2]], pa.list_(pa.int32())), 2).to_pylist() == [[0.0, 0.0], [0.0, 0.0], [0.0, 1.0]]


def test_summary_memory_does_not_follow_the_batch():
    rows, each = 10_000, 300
    rng = np.random.default_rng(2)
    words = pa.array([f"w{i}" for i in range(5_000)]).take(pa.array(rng.integers(0, 5_000, rows * each)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["r"] * rows), pa.array(np.arange(rows) // 128), _lists([each] * rows, words),
         _lists([each] * rows, pa.array(np.ones(rows * each, "int32"))), pa.array(np.full(rows, each))],
        ["repo_id", "block", "tokens", "tf", "dl"])
    made = []
    assert _peak_mb(lambda: made.extend(summarized([batch]))) < 60
    assert [n for b in made for n in b.column("block").to_pylist()] == list(range(rows // 128 + 1))


def test_only_wanted_tokens_reach_the_workers(spark):
    rows = spark.createDataFrame(
        [("a", "1", ["x", "y", "z"], [1, 2, 3], 3), ("a", "2", ["q"], [1], 1), ("b", "3", ["x", "w"], [4, 5], 2)],
        "repo_id string, id string, tokens array<string>, tf array<int>, dl long")
    terms = pa.table({"query_id": [1, 1, 2], "repo_id": ["a", "a", "b"], "token": ["z", "x", "w"]})
    kept = {r.id: (r.tokens, r.tf, r.dl) for r in wanted_tokens(rows, terms).collect()}
    assert kept == {"1": (["x", "z"], [1, 3], 3), "3": (["w"], [5], 2)}
    assert wanted_tokens(rows, terms.slice(0, 0)).collect() == []


def test_one_tokenized_index_serves_several_batches(spark):
    chunks = spark.createDataFrame(
        [("a", str(i), f"f{i}.py", f"s{i}", f"alpha{i % 3} beta gamma{i % 5}", f"{i:04d}") for i in range(40)] + [("b", "9", "e.py", None, "", "0")],
        "repo_id string, id string, file_path string, symbol_name string, content string, ord string")
    first = spark.createDataFrame([(1, "a", "alpha1 gamma2"), (2, "b", "beta")], "query_id long, repo_id string, text string")
    second = spark.createDataFrame([(1, "a", "beta s7"), (2, "none", "beta")], "query_id long, repo_id string, text string")
    shared = LexicalIndex.over(chunks).for_batches(first, second)
    assert shared.chunks is None
    assert {t for r in shared.rows.collect() for t in r.tokens} == {"alpha1", "gamma2", "beta", "s7"}
    for batch in (first, second):
        want = bm25_search(LexicalIndex.over(chunks), batch).orderBy("query_id", "bm25_rank").collect()
        assert bm25_search(shared, batch).orderBy("query_id", "bm25_rank").collect() == want
        assert bm25_search(LexicalIndex.of(chunks), batch).orderBy("query_id", "bm25_rank").collect() == want


def test_each_search_counts_its_own_tokens_only(spark):
    chunks = spark.createDataFrame(
        [("a", "1", "f.py", "s", "alpha beta gamma", "1"), ("a", "2", "g.py", "t", "beta", "2"), ("b", "3", "h.py", "u", "beta", "3")],
        "repo_id string, id string, file_path string, symbol_name string, content string, ord string")
    asked = spark.createDataFrame([(1, "a", "beta missing")], "query_id long, repo_id string, text string")
    found = LexicalIndex.of(chunks).for_terms(query_tokens(asked), small=True)
    assert sorted(found.rows.select("id", "tokens").collect()) == [("1", ["beta"]), ("2", ["beta"])]
    assert [tuple(r) for r in found.doc_freq.collect()] == [("a", "beta", 2)]
    assert [(r.repo_id, r.n_docs) for r in found.stats.collect()] == [("a", 2)]


def test_a_derived_text_is_computed_once_for_its_own_language(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "def f():\n    return 1"), ("r", "b.ts", "function g() { return 1; }"), ("r", "c.py", None)], "repo_id string, path string, content string")
    derived = files.withColumn("content", F.regexp_replace("content", "1", "2"))
    found = chunking.file_symbols(derived)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2    # one for each branch, in its projection
    assert not any("regexp_replace" in line for line in plan.splitlines() if "Filter" in line)
    assert sorted((r.path, r.symbols[0].content) for r in found.collect()) == [("a.py", "def f():\n    return 2"), ("b.ts", "function g() { return 2; }")]
    assert sorted(r.symbol_name for r in chunking.symbol_chunks(derived).collect()) == ["f", "g"]
