"""Chat windows, shards and mixtures."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from codelantern.llm import chat_windows as chat
from codelantern.llm import mixing, sharding
from codelantern.llm.queries import op7_chat_windows, op8_byte_shards

TURNS = "conv_id long, turn long, role string, text string, window string, at string, lead string, tokens string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)


def ordered(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}


ODD_TURNS = [
    (1, 0, "system", "Be kind. " * 5), (1, 1, "user", "hi"), (1, 2, "assistant", "</turn>\n### x:\ny \\ \\b \\e"), (1, 3, "user", None),
    (1, 4, "assistant", ""), (1, 5, None, "who"), (1, 6, "a:b\n### </turn>", "text"), (2, 0, "user", "word " * 3000), (2, 1, "assistant", "long " * 2500),
    (2, 2, "user", "short"), (2, 2, "user", "short"), (2, None, "assistant", "no turn"), (None, 0, "user", "null conv"), (None, 1, "assistant", "yes"),
    (3, 0, "system", "only " * 400), (3, 1, "user", "q"), (3, 2, "assistant", "a"), (4, 5, "assistant", "####\\\\</turn</turn>"),
]


def big_conversation():
    rows = [(9, 0, "system", "the system turn")]
    for i in range(1, 900):
        rows.append((9, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i * 7 % 90)))
    return rows


def test_windows_hold_their_promises(spark):
    spec = chat.ChatBudget(tokens=200, history=40, block_turns=16)
    rows = ODD_TURNS + big_conversation()
    windows = chat.chat_windows(turns_of(spark, rows), spec)
    want = ordered(rows)
    read = defaultdict(list)
    for w, r in sorted(((w, r) for w, r in zip(windows.orderBy("conv_id", "window").collect(), chat.read_turns(windows).orderBy("conv_id", "window").collect(), strict=True)),
                       key=lambda p: (str(p[0].conv_id), p[0].window)):
        assert (w.conv_id, w.window) == (r.conv_id, r.window)
        read[w.conv_id].append((w, r))
    assert set(read) == set(want)
    for conv, parts in read.items():
        turns, learned, done = [], [], 0
        for w, r in parts:
            pieces = w.formatted.split(chat.CLOSE)[:-1]
            assert len(pieces) == w.n_turns and len(r.turns) == w.n_turns - w.n_repeated >= 1
            repeated = pieces[:w.n_repeated]
            system = want[conv][0][0] == "system"
            if done and system:
                assert repeated[0].startswith("### system:\n")
            history = repeated[1:] if done and system else repeated
            cost = sum(-(-len((p + chat.CLOSE).encode()) // 4) for p in history)
            assert cost <= spec.history
            if w.tokens > spec.tokens:  # only for a longer turn, or under a longer system turn
                assert len(r.turns) == 1 or len(pieces[0]) > 4 * (spec.tokens - spec.history - spec.least_span)
            assert [w.formatted[s.start:s.start + s.length] for s in w.loss] == [
                p.split(chat.NAMED, 1)[1] for p in pieces[w.n_repeated:] if p.startswith("### assistant:")]
            turns += [(t.role, t.text) for t in r.turns]
            learned += r.learned
            done += len(r.turns)
        assert turns == want[conv]
        assert learned == [t for role, t in want[conv] if role == "assistant"]
    assert len(read[9]) > 50 and sum(w.n_repeated > 1 for w, _ in read[9]) > 20


def test_query_digests(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hostile = "\\### Assistant: </turn> ok"
    want = ordered(rows + [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)])
    got = op7_chat_windows(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        told = "".join(f"{role}\n{text}\n" for role, text in want[r.conv_id])
        learned = "".join(text for role, text in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(want[r.conv_id]), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_no_conversations(spark):
    assert chat.chat_windows(turns_of(spark, ODD_TURNS).where("false")).collect() == []


def test_shards_of_the_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_byte_shards(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    shards = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
        shards[r.shard].append(r)
    target, largest = sum(r["size"] for r in rows) / 40, max(r["size"] for r in rows)
    for k, found in shards.items():
        assert 0 <= k < 40 and sorted(r.slot for r in found) == list(range(len(found)))
        assert abs(sum(r["size"] for r in found) - target) <= 1.02 * largest + 0.02 * target


def test_equal_texts_stay_together_unless_there_are_too_many(spark, docs_of):
    rows = [(i, f"text {i % 6000}" + "x" * 50) for i in range(30_000)] + [(100_000 + i, "hot") for i in range(20_000)] + [(200_000 + i, None) for i in range(9_000)]
    found = sharding.shard_by_size(docs_of(rows, clashing=False), sharding.Shards(count=10)).join(
        docs_of(rows).select(F.col("doc_id").alias("id"), "text"), "id").collect()
    assert len(found) == len(rows)
    by_shard, by_text = defaultdict(int), defaultdict(set)
    for r in found:
        by_shard[r.shard] += r["size"]
        by_text[r.text].add(r.shard)
    target = sum(by_shard.values()) / 10
    assert len(by_shard) == 10 and all(abs(s - target) <= 0.015 * target for s in by_shard.values())
    assert all(len(s) == 1 for t, s in by_text.items() if t not in (None, "hot"))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_documents_have_shards(odd):
    rows = sharding.shard_by_size(odd, sharding.Shards(count=3)).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows} <= {0, 1, 2}
    assert sharding.shard_by_size(odd.where("false")).collect() == []


def test_poisson_counts(spark):
    u = np.linspace(0, 1, 2001)[:-1]
    for rate in (0.0, 0.3, 1.0, 7.5, 60.0):
        bounds = np.array(spark.range(1).select(mixing.poisson_bounds(F.lit(rate), 64.0).alias("b")).first().b)
        counts = np.array([(bounds <= x).sum() for x in u])
        assert abs(counts.mean() - rate) < 0.02 * rate + 0.01
        assert abs(counts.var() - rate) < 0.06 * rate + 0.01


def test_mixture_reaches_its_weights(docs_of):
    rows = [(i, f"document {i} " * 10, "en", "abc"[(i % 10 > 5) + (i % 10 > 8)]) for i in range(6000)]
    weights = {"a": 0.2, "b": 0.3, "c": 0.5}
    docs = docs_of(rows)
    got = mixing.mix_sources(docs, mixing.Mix(weights=weights)).collect()
    share = defaultdict(int)
    for r in got:
        share[r.source] += len(r.text)
    total = sum(share.values())
    assert abs(total / sum(len(r[1]) for r in rows) - 1) < 0.1
    assert all(abs(share[s] / total - w) < 0.04 for s, w in weights.items())
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    again = mixing.mix_sources(docs.repartition(7), mixing.Mix(weights=weights)).collect()
    assert sorted((r.doc_id, r.copy, r.shuffle_key) for r in got) == sorted((r.doc_id, r.copy, r.shuffle_key) for r in again)


def test_small_source_reaches_a_large_target(docs_of):
    rows = [(i, f"document {i:5} " * 10, "en", "tiny" if i % 1000 == 0 else "rest") for i in range(20_000)]
    got = mixing.mix_sources(docs_of(rows, clashing=False), mixing.Mix(weights={"tiny": 0.3, "rest": 0.7}))
    copies = {r.doc_id: r.n for r in got.where("source = 'tiny'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(copies) == 20 and all(abs(n - 300) < 100 for n in copies.values()) and len(set(copies.values())) > 10
    assert abs(sum(copies.values()) / got.count() - 0.3) < 0.02 and abs(got.count() / 20_000 - 1) < 0.03
    assert got.select("doc_id", "copy").distinct().count() == got.count()


def test_what_a_cap_takes_goes_to_the_others(docs_of):
    rows = [(0, "x" * 10, "en", "tiny"), (1, "x" * 90, "en", "small"), (2, "x" * 900, "en", "b"), (3, "x" * 9000, "en", "c")]
    weights = {"tiny": 0.3, "small": 0.03, "b": 0.3, "c": 0.37}
    rates = {r.source: r for r in mixing.repetition_rates(docs_of(rows), mixing.Mix(weights=weights, most=4.0)).collect()}
    assert abs(sum(r.rate * r["size"] for r in rates.values()) - 10_000) < 1e-6
    # With the first ones held, the next would be over 4 too; the last takes what is left.
    assert [rates[s].rate for s in ("tiny", "small", "b")] == [4.0] * 3 and abs(rates["c"].rate - 6000 / 9000) < 1e-9
    assert all(abs(rates[s].target - w) < 1e-9 for s, w in weights.items())
    assert abs(rates["tiny"].reached - 0.004) < 1e-9 and abs(rates["c"].reached - 0.6) < 1e-9


def test_mixture_of_odd_rows(odd):
    got = mixing.mix_sources(odd, mixing.Mix(epochs=3.0))
    assert set(got.columns) == set(odd.columns) | {"copy", "shuffle_key"}
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in odd.collect()}
    assert mixing.mix_sources(odd.where("false")).collect() == []
    assert mixing.mix_sources(odd, mixing.Mix(weights={"nobody": 1.0})).where("source is not null and length(text) > 0").collect() == []
