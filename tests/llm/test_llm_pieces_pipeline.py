"""Piece encoding against the library and its own inverse; the pipeline against its parts."""

import random
from dataclasses import replace
from itertools import pairwise

import numpy as np
import pytest

import corpus_pipeline
from codelantern.llm import near_copies
from codelantern.llm import piece_dropout as pd_
from codelantern.llm.queries import PIECES, op10_piece_dropout

SPEC = pd_.Dropout(PIECES)


@pytest.fixture(scope="module")
def pieces():
    return pd_.Pieces(PIECES)


def texts():
    rng = random.Random(3)
    odd = ["", " ", "  two  spaces ", "\n\t", "日本語テキスト" * 30, "a" * 700, "<s> </s> <0x0A> <unk>", "é́ 😀 ñ", " " * 90, "\u0000\u0001x",
           "The quick brown fox, jumping over 12,345 dogs!", "ａｂｃ ﬁ ½", "\r\nline\u2028sep\u00a0nbsp"]
    signs = "abcdeé ñ\n日▁😀.,-  "
    return odd + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 300))) for _ in range(60)]


def encoded(pieces, rows, rate, seed=1):
    ids, offsets = pd_.encode_batch(pieces, rows, np.arange(len(rows)), rate, seed)
    return [ids[a:b].tolist() for a, b in pairwise(offsets)]


def test_without_dropout_it_is_the_library(pieces):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    rows = [t for t in texts() if pd_.MARK not in t and "\u0000" not in t]
    assert encoded(pieces, rows, 0.0) == [library.encode(t) for t in rows]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_every_text_comes_back(pieces, rate):
    rows = texts()
    found = encoded(pieces, rows, rate)
    assert [pd_.decode_ids(pieces, ids) for ids in found] == rows
    if rate == 1.0:
        assert all(len(ids) >= len(t) for ids, t in zip(found, rows, strict=True))


def test_agenda_and_rounds_agree(pieces, monkeypatch):
    rows = [t for t in texts() if t]
    want = encoded(pieces, rows, 0.3)
    monkeypatch.setattr(pd_, "SHORT", 4)
    assert encoded(pieces, rows, 0.3) == want


def test_long_texts_are_cut_between_words(pieces):
    rows = [t for t in texts() if t] + ["some  words   of a longer text " * 40]
    want = encoded(pieces, rows, 0.3)
    ids, offsets = pd_.encode_batch(pieces, rows, np.arange(len(rows)), 0.3, 1, room=20)
    assert [ids[a:b].tolist() for a, b in pairwise(offsets)] == want


def test_seed_and_document_vary_the_cut(pieces):
    text = "international considerations notwithstanding " * 5
    one, two = encoded(pieces, [text, text], 0.2)
    assert one != two and encoded(pieces, [text], 0.2, seed=2)[0] != one
    assert encoded(pieces, [text, text], 0.2) == [one, two]


def test_repeated_words_are_cut_in_their_own_ways(pieces):
    """Places are part of the key, also where a long text is cut into stretches."""
    word = " internationalization"
    (ids,) = encoded(pieces, [word.strip() + word * 49], 0.3)
    (plain,) = encoded(pieces, [word.strip() + word * 49], 0.0)
    ways, at = set(), 0
    while at < len(ids):
        end = at + 1
        while end < len(ids) and not pieces.out[ids[end]].startswith(b" "):
            end += 1
        ways.add(tuple(ids[at:end]))
        at = end
    assert len(ways) > 10 and len(set(plain)) < 10


def test_query_decodes_everything(spark, sf_dir):
    rows = op10_piece_dropout(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)


def test_odd_rows(odd):
    found = pd_.decode_pieces(pd_.encode_pieces(odd, SPEC), SPEC).collect()
    assert len(found) == odd.count()
    assert all(r.decoded == (r.text or "") for r in found)
    empty = odd.where("false")
    assert pd_.decode_pieces(pd_.encode_pieces(empty, SPEC), SPEC).collect() == []


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "mixture", "pieces"]


def test_pipeline_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i, q in labels.items() if q == 1]
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in ids for i in good) >= 0.99 * len(good) and sum(i in ids for i in junk) <= 0.1 * len(junk)
    spoken = corpus_pipeline.language(spark, kept, folder)
    assert spoken.columns == docs.columns and spoken.count() >= 0.99 * len(ids)
    single = corpus_pipeline.near_copies(spark, spoken, folder)
    texts = [r.text for r in single.collect()]
    assert single.columns == docs.columns and len(set(texts)) == len(texts)
    assert {r.text for r in single.collect()} <= {r.text for r in spoken.collect()}
    mixed = corpus_pipeline.mixture(spark, single, folder)
    assert mixed.columns == docs.columns
    assert all(r.lossless for r in corpus_pipeline.pieces(spark, mixed, folder).collect())


def test_near_copies_by_five_words(spark, docs_of):
    rng = random.Random(8)
    rows, near = [], []
    for k in range(60):
        words = [f"w{rng.randrange(10**5)}" for _ in range(300)]
        rows.append((k, " ".join(words)))
        # Each changed word takes five shingles: 4 changes leave a similarity of about 0.87.
        for _ in range(4):
            words[rng.randrange(300)] = f"z{rng.randrange(10**5)}"
        near.append((1000 + k, " ".join(words)))
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(rows + near), "").collect()}
    assert kept >= set(range(60)) and len(kept - set(range(60))) <= 2


def shared_shingles(a, b):
    a, b = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("cut,near", [(80, False), (74, False), (67, True), (66, True), (59, True)])
def test_near_copies_are_those_that_share_enough(spark, docs_of, cut, near):
    # Two texts with 300 shingles in common and ``cut`` or 8 of their own: 0.77, 0.785, 0.80, 0.802 and 0.817.
    rng = random.Random(cut)
    rows, own = [], 8
    for k in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
        tail = [[f"{kind}{rng.randrange(10**6)}" for _ in range(n)] for kind, n in (("a", cut), ("b", own))]
        rows += [(k, " ".join(words + tail[0])), (1000 + k, " ".join(words + tail[1]))]
    assert (shared_shingles(rows[0][1], rows[1][1]) >= 0.8) == near
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs_of(rows), "").collect()}
    assert kept == set(range(80)) | (set() if near else set(range(1000, 1080)))


def test_near_copies_in_blocks_match_brute_force(spark, docs_of):
    rng = random.Random(4)
    rows, base = [], [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for k in range(120):  # related texts, many of them at 0.6 to 0.8
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    up = list(range(120))
    for i in range(120):
        for j in range(i):
            if shared_shingles(rows[i][1], rows[j][1]) >= 0.8:
                up = [min(up[i], up[j]) if u in (up[i], up[j]) else u for u in up]
    spec = replace(corpus_pipeline.NEAR_COPIES, block=16)
    found = {}
    for r in near_copies.near_copy_groups(docs_of(rows), spec).collect():
        found.setdefault(r.group, set()).add(r.id)
    want = {}
    for i, u in enumerate(up):
        want.setdefault(u, set()).add(i)
    assert len(want) > 3 and sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_one_row_of_each_group_stays(spark, docs_of):
    rng = random.Random(6)
    one, two, three, four = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    rows = [(1, one, "en", "a"), (1, one, "en", "a"), (1, one, "fr", "b"), (2, one), (2, two), (2, two), (3, three), (3, three.upper()), (3, four),
            (4, four), (None, one), (None, one)]
    for docs in (docs_of(rows), docs_of(rows[::-1]).repartition(5)):
        kept = corpus_pipeline.near_copies(spark, docs, "").collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted(
            [(0, one), (0, one), (1, one), (2, two), (3, three.upper()), (3, four)])
    assert {r.lang for r in kept if r.doc_id == 1} == {
        r.lang for r in corpus_pipeline.near_copies(spark, docs_of(rows), "").collect() if r.doc_id == 1}


def test_stages_take_odd_and_empty_tables(spark, odd, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            assert found.count() <= 8 * max(1, docs.count()), name
            if name != "pieces":
                assert found.columns == docs.columns, name
