"""Near vectors against all pairs."""

import numpy as np
import pytest

from codelantern.llm import projection_forest as pf
from codelantern.llm.queries import op5_projection_forest

SCHEMA = "vec_id long, embedding array<float>, label int, id string, node string, tile string, vector string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, cosine=0.95):
    """By row: links and the smallest id reached."""
    usable = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(np.array(v, np.float32)).all() and any(v)]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, i in enumerate(usable):
        a = np.array(np.float32(rows[i][1]), float)
        for j in usable[n + 1:]:
            b = np.array(np.float32(rows[j][1]), float)
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if least.get(r) is None else min(x for x in (least[r], i) if x is not None)
    return links, [least[root(k)] for k in range(len(rows))]


def clusters(seed, n, dims=16, spread=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n // 20):
        centre = rng.standard_normal(dims)
        for _ in range(rng.integers(1, 8)):
            rows.append((centre + spread * np.linalg.norm(centre) * rng.standard_normal(dims)).tolist())
    while len(rows) < n:
        rows.append(rng.standard_normal(dims).tolist())
    return list(enumerate(rows))


def same(got, rows, cosine=0.95):
    links, least = brute(rows, cosine)
    want = sorted(zip([str(i) for i, _ in rows], links, [str(x) for x in least], strict=True))
    return sorted((str(r.id), r.n_links, str(r.component)) for r in got), want


def test_one_leaf_is_exact(spark):
    rows = clusters(1, 200)
    got, want = same(pf.near_vectors(table(spark, rows)).collect(), rows)
    assert got == want
    assert sum(n for _, n, _ in want) > 50


def test_recall_with_many_leaves(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:700] + rng.standard_normal((700, 64)) * 0.33 / 8 * rng.uniform(0.2, 1, (700, 1))
    x = np.concatenate([base, near])
    rows = list(enumerate(x.astype(np.float32).tolist()))
    got = pf.near_vectors(table(spark, rows), pf.ForestFit(leaf=100, tile=60)).collect()
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum() - len(rows)
    found = sum(r.n_links for r in got)
    assert true > 1000 and found <= true and found >= 0.97 * true


def test_leaves_stay_small_however_small_the_sample(spark):
    """A table fifty times the sample: large leaves split on by their own vectors, and recall holds."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((7000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:3000] + rng.standard_normal((3000, 64)) * 0.33 / 8 * rng.uniform(0.2, 1, (3000, 1))
    x = np.concatenate([base, near]).astype(np.float32)
    x = np.concatenate([x, np.float32(base[0] + 1e-3 * rng.standard_normal((600, 64)))])   # a group that no direction splits, with those beside it
    spec = pf.ForestFit(leaf=100, tile=100, sample=200, leaf_sample=128)
    seen = []
    leaf_sizes = pf.leaf_sizes

    def kept(marked):
        seen.append(sorted(r.n for r in leaf_sizes(marked).collect()))
        return leaf_sizes(marked)

    pf.leaf_sizes = kept
    try:
        got = pf.near_vectors(table(spark, list(enumerate(x.tolist()))), spec).collect()
    finally:
        pf.leaf_sizes = leaf_sizes
    first, last = seen[0], seen[-1]
    assert max(first) > 5 * spec.leaf and sum(n > 2 * spec.leaf for n in last) <= spec.trees * 4 and max(last) < 1400
    assert [n for n in last if n <= 2 * spec.leaf][-1] <= 2 * spec.leaf and len(last) > 3 * len(first)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum() - len(x)
    found = sum(r.n_links for r in got)
    assert true > 300_000 and found <= true and found - 600 * 599 >= 0.97 * (true - 600 * 599)


def test_dense_group_is_counted_once(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(32)
    x = [(centre + 0.05 * rng.standard_normal(32)).tolist() for _ in range(400)] + rng.standard_normal((400, 32)).tolist()
    rows = list(enumerate(x))
    got, want = same(pf.near_vectors(table(spark, rows), pf.ForestFit(leaf=50, tile=64)).collect(), rows)
    assert got == want


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]),
            (7, one), (8, one), (8, one), (9, [2.0, 4.0, 6.0]), (10, [1.0, 2.0]), (11, [-0.0, 1.0, 0.0]), (12, [0.0, 1.0, 0.0]),
            (13, [-1.0, -2.0, -3.0]), (None, None), (8, [5.0, -1.0, 0.0])]
    got, want = same(pf.near_vectors(table(spark, rows)).collect(), rows)
    assert got == want
    assert pf.near_vectors(table(spark, rows).where("false")).collect() == []
    assert len(pf.near_vectors(table(spark, rows).where("vec_id < 7")).collect()) == 6


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_covers_the_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = op5_projection_forest(spark, folder).collect()
    links, least = brute([(r.vec_id, list(r.embedding)) for r in vectors])
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {
        (r.vec_id, n, c, c == r.vec_id) for r, n, c in zip(vectors, links, least, strict=True)}
