"""SimHash against a plain reading of its definition."""

import random
import re

import numpy as np
import pytest
import xxhash

from codelantern.llm import components as cc
from codelantern.llm import simhash
from codelantern.llm.queries import op1_simhash


def plain_print(text, words=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(prints, radius):
    """id -> smallest id reachable, for (id, fingerprint) rows."""
    ids = sorted({i for i, _ in prints})
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, x) in enumerate(prints):
        for j, y in prints[n + 1:]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_print(r.text)) for r in rows]
    want = plain_groups(prints, 4)
    got = op1_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", want[i]) for i, p in prints}
    assert len(got) == len(rows)


def test_near_copies_in_chains(spark, docs_of):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    texts = []
    for i in range(40):  # each copy differs from the one before in one word
        base = list(base)
        base[rng.randrange(800)] = f"new{i}"
        texts.append(" ".join(base))
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(100)) for _ in range(60)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    want = plain_groups([(i, plain_print(t)) for i, t in rows], 4)
    got = {r.id: r.component for r in simhash.near_duplicates(docs_of(rows), simhash.SimHash()).collect()}
    assert got == want
    assert len({want[i * 3] for i in range(40)}) == 1


@pytest.mark.parametrize("bits,radius", [(64, 12), (256, 60)])
def test_tiles_find_every_link(bits, radius):
    rng = np.random.default_rng(2)
    parts = bits // 64
    prints = rng.integers(0, 2**63, (700, parts), dtype=np.uint64)
    for i in range(300):  # near copies of others, with a few bits changed
        prints[i + 400] = prints[i]
        for bit in rng.integers(0, bits, rng.integers(0, 2 * radius)):
            prints[i + 400, bit // 64] ^= np.uint64(1 << int(bit % 64))
    nodes, at = np.arange(700) * 10, np.arange(700)
    src, dst = simhash.tile_stars(nodes, at, at, prints, prints, radius, tile=64, pending=50)
    got = cc.spanning_stars(700, src // 10, dst // 10)
    apart = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2, dtype=int)
    a, b = np.nonzero(apart <= radius)
    assert np.array_equal(got, cc.spanning_stars(700, a, b))


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd, simhash.SimHash()).collect()
    assert len(rows) == odd.count()
    by_id = {r.id: r for r in rows if r.id is not None}
    assert by_id[1].f0 == by_id[2].f0 == by_id[3].f0 == 0
    assert by_id[1].component == by_id[2].component == by_id[3].component == 1
    assert by_id[4].component == by_id[5].component == by_id[-3].component == -3
    assert sorted(r.component is None for r in rows if r.id is None) == [False, True]
    for r in rows:
        text = next(t for t in odd.where("doc_id <=> " + ("null" if r.id is None else str(r.id))).select("text").collect())[0]
        if r.id is not None:
            assert r.f0 & (2**64 - 1) == plain_print(text)


def test_unlike_texts_of_one_id_do_not_join_groups(spark, docs_of):
    rng = random.Random(7)
    one, two = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(2))
    got = simhash.near_duplicates(docs_of([(1, one), (1, two), (5, one + " x"), (6, two + " x")]), simhash.SimHash(radius=12))
    assert sorted((r.id, r.component) for r in got.collect()) == [(1, 1), (1, 1), (5, 1), (6, 1)]
    got = simhash.near_duplicates(docs_of([(9, one), (9, two), (5, one), (12, two)]), simhash.SimHash(radius=4)).collect()
    assert sorted((r.id, r.component) for r in got) == [(5, 5), (9, 5), (9, 9), (12, 9)]


def test_distinct_shingles_count_once():
    spec = simhash.SimHash(words=2, distinct=True)
    assert simhash.fingerprint("a b c a b c a b c", spec) == simhash.fingerprint("b c a b", spec)
    assert simhash.fingerprint("a b c a b c a b c", simhash.SimHash(words=2)) != simhash.fingerprint("a b c a b", simhash.SimHash(words=2))
    assert simhash.fingerprint("one", spec) == simhash.fingerprint("ONE ", simhash.SimHash(words=2)) != [0]


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([]).where("false")).collect() == []


def test_components_of_long_paths_hubs_and_rings(spark):
    n = 400
    links = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(7, 7), (None, 3), (5, None), (5000, 5001), (5000, 5001)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(300)} | {2000 + i: 2000 for i in range(50)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert cc.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_blocks_hold_every_count():
    spec = simhash.SimHash(max_block=300)
    of, spans = simhash._blocks([(i, 10 * (32 - abs(32 - i)) + 1) for i in range(65)], spec)
    for ones, (first, k) in of.items():
        assert all(low <= ones <= high for low, high in spans[first:first + k])
    assert spans == sorted(spans)
