import random

import pytest

from codelantern.config import SearchOptions
from codelantern.operators import fusion
from codelantern.operators.lexical import LexicalIndex, bm25_search
from codelantern.operators.references import append_hits, reference_lookup
from codelantern.operators.semantic import semantic_search
from codelantern.plans.retrieve import hybrid_retrieve
from tests import model

CHUNKS = (
    "id string, repo_id string, file_path string, language string, content string, start_line int, end_line int, "
    "symbol_name string, symbol_type string, embedding array<float>, ord bigint"
)
# Small limits force the paths for batches too large to broadcast.
LARGE = SearchOptions(broadcast_rows=1, block_rows=7, block_queries=2, salts=3)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    words = ["loadConfig", "user.getName", "parse_tree", "retry", "retry", "cache", "éclair", "OAuth2Token", "a", "$el"]
    rows = []
    for i in range(90):
        repo = "hot/repo" if i % 3 else f"r/{i % 5}"
        content = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))
        vector = [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)] if i % 11 else ([1.0, 2.0] if i % 2 else None)
        rows.append((f"c{i}", repo, f"src/{rng.choice(words)}_{i % 4}.ts", "typescript", content, 1, 3,
                     rng.choice([None, "", "loadConfig", "retry"]), "function", vector, i))
    questions = [(q, rng.choice(["hot/repo", "r/0", "r/3", "none/here"]), " ".join(rng.sample(words, 3)),
                  [rng.uniform(-1, 1) for _ in range(4)]) for q in range(12)]
    questions += [(98, "hot/repo", "  ", [1.0, 0.0, 0.0, 0.0]), (99, "hot/repo", "zzz", [0.0, 0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(5)
    asked = spark.createDataFrame(questions, "query_id bigint, repo_id string, text string, vector array<float>")
    names = CHUNKS.replace(" array<float>", "").split(", ")
    as_dicts = [dict(zip([n.split()[0] for n in names], r, strict=True)) for r in rows]
    return chunks, asked, as_dicts, questions


def by_query(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(value(r))
    return out


@pytest.mark.parametrize("options", [SearchOptions(), LARGE], ids=["broadcast", "shuffled"])
def test_bm25_against_model(data, options):
    chunks, asked, dicts, questions = data
    found = bm25_search(LexicalIndex.over(chunks), asked, options).orderBy("query_id", "bm25_rank").collect()
    want = {}
    for qid, repo, text, _ in questions:
        mine = [c for c in dicts if c["repo_id"] == repo]
        ranked = model.bm25(mine, text) if mine else []
        if ranked:
            want[qid] = ranked
    assert by_query(found, lambda r: (r.id, r.score)) == want


def test_saved_index_gives_the_same(spark, data, tmp_path):
    chunks, asked, *_ = data
    path = str(tmp_path / "index")
    LexicalIndex.save(chunks, path)
    order = ["query_id", "bm25_rank"]
    fresh = bm25_search(LexicalIndex.over(chunks), asked).orderBy(*order).collect()
    for options in (SearchOptions(), LARGE):
        assert bm25_search(LexicalIndex.load(spark, path), asked, options).orderBy(*order).collect() == fresh


def test_empty_vectors_score_zero(spark, data):
    chunks, *_ = data
    asked = spark.createDataFrame([(1, "hot/repo", "x", [])], "query_id bigint, repo_id string, text string, vector array<float>")
    for options in (SearchOptions(), LARGE):
        rows = semantic_search(chunks, asked, options).collect()
        assert len(rows) == options.top_k and {r.cosine for r in rows} == {0.0}


@pytest.mark.parametrize("options", [SearchOptions(), LARGE], ids=["broadcast", "blocks"])
def test_semantic_against_model(data, options):
    chunks, asked, dicts, questions = data
    found = semantic_search(chunks, asked, options).orderBy("query_id", "semantic_rank").collect()
    want = {}
    for qid, repo, text, vector in questions:
        near = model.nearest([c for c in dicts if c["repo_id"] == repo], vector)
        if text.strip() and near:
            want[qid] = near
    got = by_query(found, lambda r: r.id)
    assert got.keys() == want.keys()
    for qid in want:
        assert got[qid] == want[qid], qid
    assert all(r.score == 1 / r.semantic_rank for r in found)


def ranked(spark, ids, column):
    rows = [(1, "r", i, n) for n, i in enumerate(ids, 1)]
    return spark.createDataFrame(rows, f"query_id bigint, repo_id string, id string, {column} int")


def test_fusion_golden(spark):
    fused = fusion.fuse(ranked(spark, "abc", "semantic_rank"), ranked(spark, "cda", "bm25_rank")).orderBy("rank").collect()
    assert [(r.id, r.semantic_rank, r.bm25_rank, r.rrf_score, r.source) for r in fused] == [
        ("a", 1, 3, 0.03227, "hybrid"), ("c", 3, 1, 0.03227, "hybrid"),
        ("b", 2, None, 0.01613, "semantic"), ("d", None, 2, 0.01613, "bm25"),
    ]


def test_fusion_properties(spark):
    rng = random.Random(3)
    semantic, lexical = rng.sample(range(40), 20), rng.sample(range(40), 20)
    ids = [[f"x{i}" for i in side] for side in (semantic, lexical)]
    fused = fusion.fuse(ranked(spark, ids[0], "semantic_rank"), ranked(spark, ids[1], "bm25_rank")).orderBy("rank").collect()
    assert [(r.id, r.semantic_rank, r.bm25_rank, r.rrf_score) for r in fused] == model.fuse(*ids)
    hybrid = [r.rrf_score for r in fused if r.source == "hybrid"]
    single = [r.rrf_score for r in fused if r.source != "hybrid"]
    assert min(hybrid) > max(single)
    swapped = fusion.fuse(ranked(spark, ids[1], "semantic_rank"), ranked(spark, ids[0], "bm25_rank")).collect()
    assert {(r.id, r.rrf_score) for r in swapped} == {(r.id, r.rrf_score) for r in fused}


def signal(spark, semantic, lexical, rrf_k=60):
    queries = spark.createDataFrame([(1,)], "query_id bigint")
    places = spark.createDataFrame([("r", i, f"{i}.ts", 4) for i in "abcd"], "repo_id string, id string, file_path string, start_line int")
    options = SearchOptions(rrf_k=rrf_k)
    fused = fusion.fuse(ranked(spark, semantic, "semantic_rank"), ranked(spark, lexical, "bm25_rank"), options)
    row = fusion.confidence(queries, fusion.top_hits(fused, options), places).first()
    return row.score, row.low_confidence, row.reason


def test_confidence_cases(spark):
    assert signal(spark, "", "")[:2] == (0.0, True)
    assert signal(spark, "a", "", 100) == (
        0.0099, True, "Top retrieval score (0.0099) is below threshold (0.01). Context may be weak.")
    assert signal(spark, "a", "a") == (
        0.9837, False, 'High confidence: Top candidate "a.ts:4" matched by both semantic vectors and BM25 keywords.')
    assert signal(spark, "ab", "") == (0.4097, False, "Moderate confidence: Candidate found via semantic search.")
    assert signal(spark, "", "a") == (0.4097, False, "Good confidence: Clear top match in bm25 search.")


def test_hybrid_is_whole(data):
    chunks, asked, *_ = data
    result = hybrid_retrieve(asked, chunks, LexicalIndex.over(chunks))
    assert result.confidence.count() == asked.count() == result.stats.count()
    hits = result.hits.collect()
    assert {r.query_id for r in hits} and all(1 <= r.rank <= 8 for r in hits)
    nothing = result.confidence.where("query_id = 98").first()
    assert nothing.low_confidence and nothing.score == 0.0


def test_reference_lookup_and_append(spark, data):
    chunks, _, dicts, _ = data
    refs = spark.createDataFrame(
        [(1, "hot/repo", "LOADCONFIG"), (2, "hot/repo", "rc/ret"), (3, "hot/repo", " "), (4, "none", "x"), (5, "hot/repo", "qqq")],
        "query_id bigint, repo_id string, symbol string")
    rows = reference_lookup(LexicalIndex.over(chunks), chunks, refs, 3).orderBy("query_id", "position").collect()
    hot = [c for c in dicts if c["repo_id"] == "hot/repo"]
    exact = [i for i, _ in model.bm25(hot, "LOADCONFIG", 3)]
    by_id = {c["id"]: c for c in hot}
    exact = [i for i in exact if (by_id[i]["symbol_name"] or "").lower() == "loadconfig" or "loadconfig" in by_id[i]["file_path"].lower()]
    fallback = [c["id"] for c in hot if "rc/ret" in c["file_path"].lower() or "rc/ret" in (c["symbol_name"] or "").lower()][:3]
    assert [r.id for r in rows if r.query_id == 1] == exact
    assert [(r.id, r.score, r.bm25_rank) for r in rows if r.query_id == 2] == [(i, 1 / n, None) for n, i in enumerate(fallback, 1)]
    assert {r.query_id for r in rows} == {1, 2}
    late = [(f"n{i}", "far/away", f"src/{i}.ts", "typescript", "x", 1, 1, "needleHere" if i == 1500 else "other", "function", None, i)
            for i in range(1501)]
    far = spark.createDataFrame(late, CHUNKS)
    asked = spark.createDataFrame([(1, "far/away", "edleher")], "query_id bigint, repo_id string, symbol string")
    assert [r.id for r in reference_lookup(LexicalIndex.over(far), far, asked, 3).collect()] == ["n1500"]
    hits = spark.createDataFrame([(2, fallback[0], 1), (2, "other", 2)], "query_id bigint, id string, rank int")
    merged = append_hits(hits, spark.createDataFrame(rows)).where("query_id = 2").orderBy("rank").collect()
    assert [r.id for r in merged] == [fallback[0], "other", *fallback[1:]]


def test_large_batches_do_not_broadcast_text(data):
    chunks, asked, *_ = data
    plan = bm25_search(LexicalIndex.over(chunks), asked, LARGE)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
