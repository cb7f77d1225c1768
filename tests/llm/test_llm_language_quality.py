"""Language and quality: held-out accuracy, and fixed results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelantern.llm import langid
from codelantern.llm import quality_trees as qt
from codelantern.llm.queries import op2_language, op6_quality_trees


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = op2_language(spark, small).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_backing_off():
    word = (np.log(np.array([[0.9, 0.1]])))
    grams = [({"^he": 0}, np.log([[0.2, 0.8]])), ({"he": 0, "xx": 1}, np.log([[0.6, 0.4], [0.3, 0.7]])), ({"h": 0}, np.log([[0.5, 0.5]]))]
    model = langid.LanguageModel(["aa", "bb"], {"the": 0}, word, grams)
    assert np.allclose(model.backed_off(["hello"]), np.log([0.2, 0.8]))     # the longest known one decides
    assert np.allclose(model.backed_off(["oxx"]), np.log([0.3, 0.7]))
    assert np.allclose(model.backed_off(["zz"]), 0)
    assert np.allclose(model.backed_off(["zz", "oxx", "hello"]), [[0, 0], np.log([0.3, 0.7]), np.log([0.2, 0.8])])
    assert model.predict("the the") == ("aa", pytest.approx(0.81 / 0.82))
    assert model.predict("hello hello hello")[0] == "bb"
    assert model.predict("zz")[0] == "aa"                                 # a tie: the first by name
    assert model.predict("12 -- ²") == model.predict(None) == ("und", 0.0)


def test_unlearned_languages_know_few_words(spark, small):
    """The share of the likelihood is near 1 for texts of unlearned languages and for invented words; known words tell."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs, F.lit(True))
    strange = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "minden emberi lény szabadon születik és egyenlő méltósága van",
        "qzx vbnk wrtp zzxq plmk jhgf " * 40, "wszyscy ludzie rodzą się wolni i równi pod względem swej godności " * 30]
    for text in strange:
        lang, score, known = model.judge(text)
        assert lang in model.langs and known < 0.4
    found = langid.predict_languages(docs, model).where("lang_pred <> 'und'")
    assert found.where("known < 0.4").count() <= 0.005 * found.count()
    only = langid.LanguageModel(["aa"], {"the": 0}, np.zeros((1, 1)), [({}, np.zeros((0, 1)))] * 5)
    assert only.judge("the the other " * 200_000)[2] == pytest.approx(2 / 3)


def test_the_cache_of_words_may_overflow():
    model = langid.LanguageModel(["aa", "bb"], {"the": 0}, np.log([[0.9, 0.1]]), [({"a": 0, "b": 1}, np.log([[0.9, 0.1], [0.1, 0.9]]))], room=4)
    words = [f"{'ab'[i % 3 == 0]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(20_000)]
    want = model.backed_off(words).sum(axis=0)
    assert np.allclose(model.totals(words), want)


def test_odd_texts_have_languages(odd):
    model = langid.fit_languages(odd, F.lit(True))
    rows = langid.predict_languages(odd, model).collect()
    assert len(rows) == odd.count()
    assert set(model.langs) == {"en", "ja", "es"}
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert r.lang_pred in {"und", *model.langs}


def test_nothing_to_learn(docs_of):
    docs = docs_of([(1, "some text", None), (2, None, "en")])
    model = langid.fit_languages(docs, F.lit(False))
    assert [r.lang_pred for r in langid.predict_languages(docs, model).collect()] == ["und", "und"]
    empty = docs.where("false")
    assert langid.predict_languages(empty, langid.fit_languages(empty, F.lit(True))).collect() == []


def test_quality_of_held_out_documents(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    rows = op6_quality_trees(spark, small).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_flat_trees_follow_their_cuts():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = qt.grow(x, y, qt.TreeFit(trees=30, depth=3))
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = forest.start
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (1 if row[feature[node]] <= cut[node] else 2)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.scores(x[:50]), [walk(r) for r in x[:50]])


def test_odd_texts_are_scored(spark, odd):
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, 0, None), (4, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, 0), (99, 1, 0), (8, 7, 0)],
        "doc_id long, quality int, toxic int")
    forest = qt.fit_quality(odd, labels, F.lit(True))
    rows = qt.score_quality(odd, forest).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    none = qt.score_quality(odd, qt.fit_quality(odd, labels.where("false"), F.lit(True)))
    assert {r.score for r in none.collect()} == {0.5}
    assert qt.score_quality(odd.where("false"), forest).collect() == []


def test_statistics_are_finite():
    for text in (None, "", " ", "\n", "a", "𝒳" * 10, "a b " * 50_000):
        assert np.isfinite(qt.statistics(text)).all()
