"""What stays on disk: shuffle files of a run, tokens stored twice, token rows moved whole."""

import time

import numpy as np

from pyspark.sql import functions as F

from codelantern.config import SearchOptions
from codelantern.operators import lexical
from codelantern.operators.sizing import durable
from codelantern.sources import store as stores
from codelantern.sources.store import ChunkStore


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_") and f.endswith(".data")}


def _chunks(spark, rows):
    rows = [(i, repo, f"{i}.py", "text", text, 1, 1, None, None, [1.0], i) for repo, i, text in rows]
    return spark.createDataFrame(rows, stores.CHUNKS)


def _sums(index):
    return sorted(tuple(r) for r in index.doc_freq.collect()), sorted(tuple(r) for r in index.stats.collect())


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    rows = spark.range(1000).repartition(3)
    durable(rows)
    end = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_frequencies_are_the_same_in_any_number_of_runs(spark, tmp_path, monkeypatch):
    first = [(f"r{i % 4}", f"c{i}", f"alpha word{i} w{i % 3}") for i in range(24)]
    second = [(f"r{i % 4}", f"c{i}", f"beta word{i}") for i in range(0, 32, 3)]
    found = []
    for name, tokens in (("one", 1 << 25), ("many", 7)):
        monkeypatch.setattr(stores, "SUM_TOKENS", tokens)
        store = ChunkStore(spark, str(tmp_path / name))
        store.replace(_chunks(spark, first))
        store.upsert(_chunks(spark, second))
        found.append(_sums(store.index()))
    live = {i: (repo, i, text) for repo, i, text in first + second}
    plain = lexical.LexicalIndex.of(_chunks(spark, list(live.values())))
    want = sorted((r.repo_id, r.token, r.df) for r in plain.doc_freq.collect())
    assert found[0] == found[1] and found[0][0] == want
    tables = [p for p in (tmp_path / "many").rglob("*.parquet") if "/hidden/" in str(p)]
    assert tables and all("tokens" not in spark.read.parquet(str(p)).columns for p in tables)


def test_bounds_of_a_block_in_parts(spark):
    blocks = spark.createDataFrame(
        [("a", 0, 5, ["x", "y"], [2, 1], [4, 9]), ("a", 0, 5, ["x"], [1], [3]), ("a", 1, 5, ["z"], [1], [3]), ("b", 0, 5, ["x"], [1], [3])],
        "repo_id string, seq int, block long, tokens array<string>, tf array<int>, dl array<long>")
    terms = spark.createDataFrame(
        [(7, "a", "x", 0, 5.0, 2.0), (7, "a", "y", 1, 5.0, 3.0), (8, "a", "x", 0, 5.0, 2.0)],
        "query_id long, repo_id string, token string, pos int, avg_dl double, idf double")

    def score(idf, tf, dl):
        return lexical._term_scores(idf, tf, dl, 5.0)

    found = lexical.block_bounds(lexical.LexicalIndex(None, None, None, None, blocks), terms)
    assert found.columns == ["query_id", "repo_id", "seq", "block", "bound"]
    rows = sorted(tuple(r) for r in found.collect())
    want = sorted([(7, "a", 0, 5, score(2.0, 2, 4) + score(3.0, 1, 9)), (7, "a", 0, 5, score(2.0, 1, 3)),
                   (8, "a", 0, 5, score(2.0, 2, 4)), (8, "a", 0, 5, score(2.0, 1, 3))])
    assert [r[:4] for r in rows] == [r[:4] for r in want] and np.allclose([r[4] for r in rows], [r[4] for r in want])


def test_hidden_rows_stay_out_of_a_bounded_search(spark, tmp_path):
    """Token lists are cut down before hidden rows go, whether these are sent or joined."""
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.replace(_chunks(spark, [("a", f"c{i}", f"alpha beta{i % 5} gamma") for i in range(300)]))
    store.upsert(_chunks(spark, [("a", f"c{i}", f"delta beta{i % 5}") for i in range(0, 300, 2)]))
    asked = spark.createDataFrame([(1, "a", "alpha beta2"), (2, "a", "delta gamma"), (3, "none", "alpha")], "query_id long, repo_id string, text string")
    index = store.snapshot().of(asked)[1]
    want = sorted(tuple(r) for r in lexical.bm25_search(index, asked, SearchOptions(bounded_from=10**9)).collect())
    for options in (SearchOptions(bounded_from=0), SearchOptions(bounded_from=0, listed_blocks=1)):
        assert sorted(tuple(r) for r in lexical.bm25_search(index, asked, options).collect()) == want
    assert want and index.thinned(lexical.weighted_terms(index, lexical.query_tokens(asked), True).toArrow()).rows.where(F.size("tokens") > 3).isEmpty()
