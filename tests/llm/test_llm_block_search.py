"""Ranked search by blocks against a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_odd import ODD

from codelantern.llm import block_search
from codelantern.llm.block_search import BlockSearch, rank_documents

ITEMS = "item_id long, text string, rank string, item string, score string"


def terms(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain(docs, items, best=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = set()
    for item, text in items:
        scores = []
        for place, (doc, c) in enumerate(held):
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, place))
        for rank, (score, missing, doc, _) in enumerate(sorted(scores)[:best], 1):
            rows.add((item, rank, None if missing else doc, -score))
    return rows


def random_docs(n, seed, own=0):
    """Some topics with words of their own, words that all share, copies and ties; ``own`` words are of few documents."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        topic = draw.randrange(12)
        words = draw.choices([f"t{topic}w{j}" for j in range(40)], k=draw.randrange(1, 60)) + draw.choices(["the", "of", "Une", "été", "ß9"], k=30)
        words += [f"own{draw.randrange(n)}" for _ in range(own)]
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
    return rows + [(10_000 + i, rows[i % 7][1]) for i in range(60)]


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], ITEMS)


def found(frame):
    rows = [tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("spec", [
    BlockSearch(), BlockSearch(segment_docs=50, block_docs=4), BlockSearch(segment_docs=64, segment_postings=300, best=3),
    BlockSearch(item_bytes=600, segment_docs=100, block_docs=8, salts=3)])
def test_equals_a_plain_scan(spark, docs_of, spec):
    docs = random_docs(400, 1) + [(r[0], r[1]) for r in ODD] + [(77, "t1w1 " * 50), (77, "t1w1 " * 50)]
    items = [(i, " ".join(f"T{i % 12}W{j}" for j in range(i, i + 6)) + " the été") for i in range(15)]
    items += [(90, None), (91, ""), (92, "the of"), (93, "unheard words"), (94, "one TWO x日本語の文章です。"), (None, "t3w1 t3w2")]
    got = found(rank_documents(docs_of(docs).repartition(3), items_of(spark, items), spec))
    assert got == plain(docs, items, spec.best)


def test_empty_tables(spark, docs_of):
    items = items_of(spark, [(1, "a b")])
    assert rank_documents(docs_of([(1, "a")]).limit(0), items).count() == 0
    assert rank_documents(docs_of([(1, "a")]), items.limit(0)).count() == 0
    assert rank_documents(docs_of([(1, None), (2, "..")]), items).count() == 0


def test_long_texts_are_counted_in_stretches(monkeypatch):
    monkeypatch.setattr(block_search, "_STRETCH", 10)
    text = ("Ab cd-ef été " * 50).encode()
    assert block_search._counted(text, None) == (200, Counter({b"ab": 50, b"cd": 50, b"ef": 50, "été".encode(): 50}))
    assert block_search._counted(text, {b"cd": 3}) == (200, Counter({3: 50}))


def test_blocks_are_skipped():
    """Items that a few documents answer well leave most blocks unread, and the answers are those of a scan."""
    docs = random_docs(2000, 2, own=10)
    held = [(d, Counter(terms(t))) for d, t in docs]
    numbers = {t: i for i, t in enumerate(sorted({t for _, c in held for t in c}))}
    sizes = [len(c) for _, c in held]
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    number = np.array([numbers[t] for _, c in held for t in c])
    impact = np.array([n * 100 // (n + 1) for _, c in held for n in c.values()])
    s = block_search.segment_of(np.array([d for d, _ in held]), np.ones(len(held), bool), ptr, number, impact, BlockSearch())
    # every block's summary is the maximum of its members
    for t in range(0, len(s["names"]), 37):
        for b in range(s["first"][t], s["first"][t + 1]):
            members = s["member"][s["member_ptr"][b]:s["member_ptr"][b + 1]]
            want = {}
            for d in members:
                for at in range(s["ptr"][d], s["ptr"][d + 1]):
                    if not s["shared"][s["term"][at]]:
                        want[s["term"][at]] = max(want.get(s["term"][at], 0), s["impact"][at])
            got = slice(s["most_ptr"][b], s["most_ptr"][b + 1])
            assert dict(zip(s["most_term"][got], s["most"][got], strict=True)) == want
    assert s["shared"].any() and not s["shared"].all()
    df = Counter(number.tolist())
    asked = []
    for i in range(12):
        words = sorted(set(docs[i * 31][1].split()))
        at = np.array(sorted(numbers[w.lower() if w.isascii() else w] for w in words))
        asked.append((i, at, np.array([int(1000 * math.log(2 * len(docs) / (2 * df[t] + 1)) + 1) for t in at.tolist()])))
    best = block_search.BestDocuments(asked, 5)
    best.show(s)
    for item, at, weights in asked:
        dense = np.zeros(len(numbers), np.int64)
        dense[at] = weights
        scores = np.add.reduceat(dense[number] * impact, ptr[:-1])
        order = np.lexsort((s["ids"], -scores))[:5]
        assert best.found[item][0].tolist() == scores[order].tolist() and best.found[item][1].tolist() == s["ids"][order].tolist()
    assert best.read < 0.5 * best.blocks


def test_passages_are_found_first(spark, sf_dir):
    """A document that holds an item's text whole is among its best."""
    ranked = block_search.rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(ranked) == plain(list(texts.items()), items)
    assert ranked.groupBy("item_id").agg(F.max("rank").alias("n")).where("n > 10").count() == 0
