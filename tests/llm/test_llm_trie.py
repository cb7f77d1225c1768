"""The tree of conversation beginnings against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from codelantern.llm import conversation_trie as ct
from codelantern.llm.conversation_trie import Branches, DoubleArray, TrieSpec, conversation_trie
from codelantern.llm.queries import op12_conversation_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, x string, part string, conv string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: tuple((r, t) for _, r, t in sorted(v)) for c, v in convs.items()}


def rebuilt(convs):
    found = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        origin = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        found[c] = convs.get(origin, ())[:h] + turns[h:]
    return found


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * len(node[-1][1] if node else "")
    return sorted((
        min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if convs[c] == n))).encode()).hexdigest())
        for n, m in members.items())


def rows_of(frame):
    assert frame.columns == COLUMNS and {t for c, t in frame.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(tuple(r) for r in frame.collect())


def by_key(rows):
    return sorted(rows, key=lambda r: (r[1], r[0], r[7]))


ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, None, "first"), (1, 1, "assistant", ""), (2, None, "", "first"), (2, 0, "user", "hi"),
    (None, 0, "user", "nobody"), (100, 3, "a", "b" * 5000), (100, 3, "a", "b" * 5000), (101, 0, "ab", ""), (102, 0, "a", "b"), (-7, 0, "user", "minus"),
    (-107, 0, "user", "x"), (-100, 0, "user", "y"), (-100, 1, "user", "z"), (9_000_000_000_000_000_001, 0, "user", "é😀"), (300, None, None, None),
]


def random_turns(seed, n_convs=150):
    """Many ids in three hundreds, few texts, one conversation of which many are copies, one very long one."""
    draw = random.Random(seed)
    rows = []
    for c in range(n_convs):
        conv = draw.randrange(300) if c % 3 else 500 + c
        for t in range(draw.randrange(1, 9) if c % 3 else 4):
            rows.append((conv, t, "user" if t % 2 else "assistant", "same" if c % 3 == 0 else draw.choice(["a", "bb", "ccc"])))
    return rows + [(42, t, "user", f"turn {t % 7}") for t in range(700)]


@pytest.mark.parametrize("spec", [TrieSpec(), TrieSpec(strand_turns=5, shard_strands=3, sum_depths=16, wide=2)])
def test_equals_a_plain_tree(spark, spec):
    rows = ODD + random_turns(3)
    turns = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS).repartition(3)
    branches = Branches(shared=lambda c: ct.F.crc32(c.cast("string").cast("binary")) % 6, origin=lambda c: c - c % 100, most=5)
    assert by_key(rows_of(conversation_trie(turns, spec, branches))) == by_key(plain(rebuilt(ordered(rows))))
    assert by_key(rows_of(conversation_trie(turns, spec))) == by_key(plain(ordered(rows)))


def test_without_measured_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ct, "is_small", lambda *_: False)
    rows = random_turns(5, 40)
    turns = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)
    assert by_key(rows_of(conversation_trie(turns))) == by_key(plain(ordered(rows)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert rows_of(conversation_trie(empty)) == []
    assert rows_of(conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "", "", "", "")], TURNS))) == []


def test_double_array_holds_what_it_was_given():
    draw = random.Random(4)
    for _ in range(30):
        top = draw.choice([1, 3, 40, 4000])
        sequences = [[draw.randrange(1, top + 1) for _ in range(draw.randrange(0, 7))] for _ in range(draw.randrange(1, 200))]
        ptr = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
        trie = DoubleArray(ptr, np.array([c for s in sequences for c in s], np.int64))
        slots = {}
        for s in sequences:
            at = np.zeros(1, np.int64)
            for d, c in enumerate(s, 1):
                at = trie.step(at, np.array([c]))
                assert at[0] > 0 and slots.setdefault(tuple(s[:d]), at[0]) == at[0]
        assert len(set(slots.values())) == len(slots)
        for prefix, slot in slots.items():
            for c in range(1, min(top, 40) + 1):
                child = trie.step(np.array([slot]), np.array([c]))[0]
                assert child == slots.get((*prefix, c), -1)


def test_query_against_plain_tree(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_key(rows_of(op12_conversation_trie(spark, sf_dir))) == by_key(plain(rebuilt(ordered(rows))))
