"""Multiset fingerprints and URL verdicts against plain versions."""

import hashlib

import numpy as np

from codelantern.llm import multiset_hash as mh
from codelantern.llm import ordered
from codelantern.llm import url_filter as uf
from codelantern.llm.queries import URL_RULES, op3_multiset_hash, op4_url_filter


def test_very_repetitive_texts_do_not_wrap():
    line, empty = "the same line", mh.vector("")
    many, half = mh.vector((line + "\n") * 40_000), mh.vector((line + "\n") * 20_000)
    assert mh.likeness(many, half) > 0.999
    assert mh.as_hex(mh.vector((line + "\n") * 32_768)) != mh.as_hex(empty)
    assert mh.as_hex(mh.added(many, (line + "\n") * 20_000, -1)) == mh.as_hex(half)


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in op3_multiset_hash(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for i, following in zip(ids, ids[1:] + ids[:1], strict=True):
        text, r = texts[i], got[i]
        half = len(text) // 2
        new = text[:len(text) - half] + texts[following][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mh.as_hex(mh.vector(text)), mh.as_hex(mh.vector(new)))
        assert (r.near_next == 1) == (r.fingerprint == got[following].fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.median([r.near_edited for r in got.values()]) > 0.35 > 0.1 > np.median([r.near_next for r in got.values()])


def test_order_insertion_and_deletion():
    a, b, c = "First line. And more.", "Second line", "Third line."
    assert np.array_equal(mh.vector(f"{a}\n{b}\n{c}"), mh.vector(f"{c}\n{a}\n{b}"))
    assert not np.array_equal(mh.vector(f"{a}\n{b}"), mh.vector(f"{a}\n{b}\n{b}"))
    grown = mh.added(mh.vector(f"{a}\n{b}"), c)
    assert np.array_equal(grown, mh.vector(f"{c}\n{b}\n{a}"))
    assert np.array_equal(mh.added(grown, b, -1), mh.vector(f"{a}\n{c}"))
    assert not np.array_equal(mh.vector("ab\nc"), mh.vector("a\nbc"))
    assert mh.likeness(mh.vector(""), mh.vector(None)) == 1 and mh.likeness(mh.vector(""), mh.vector(a)) == 0


def test_likeness_follows_the_shared_part():
    lines = [f"line number {i} of this text" for i in range(200)]
    for kept in (200, 150, 100, 50, 0):
        other = lines[:kept] + [f"another {i} there" for i in range(200 - kept)]
        assert abs(mh.likeness(mh.vector("\n".join(lines)), mh.vector("\n".join(other))) - kept / 200) < 0.2


def plain_neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1], strict=True)]


def test_odd_rows_and_block_borders(docs_of):
    from tests_odd import ODD

    rows = [r[:2] for r in ODD] + [(2**62 + i, f"big {i}\nline {i}") for i in range(40)] + [(2**53 + 1, "p"), (2**53, "q")]
    want = sorted((str(i), hashlib.sha256(mh.edited(t, n).encode()).hexdigest()) for i, t, n in plain_neighbours(rows))
    for block_bytes in (1 << 30, 20_000, 8):
        got = mh.fingerprint_edits(docs_of(rows), block_bytes=block_bytes).collect()
        assert sorted((str(r.id), r.edited_sha256) for r in got) == want


def test_single_and_empty_tables(docs_of):
    one = mh.fingerprint_edits(docs_of([(3, "abcd")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    assert mh.fingerprint_edits(docs_of([]).where("false")).collect() == []
    assert ordered.descending_blocks(docs_of([]).where("false"), "doc_id", "text", 10).collect() == []


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def plain_rule(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits, default=(0, None, None))[1:]


def test_urls_match_the_rules(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op4_url_filter(spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == plain_parts(urls[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://WWW.Example.COM/en/1?x=/y", "http://example.com", "http://com/", "http://xcom/",
            "ftp://a.net/es/", "http://a.net/es", "http://u@b.org:80/p#f?q", "http://ÄB.net/fr/x", "x://y://z/", "http://a.com?b/", "http://a.com#/en/"]
    rows = [(i, u, None if i % 2 else "<p>hello world</p>", "x", "y") for i, u in enumerate(urls)] + [(0, None, "", "x", "y"), (None, "http://a.org/", "<b", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, verdict string")
    got = uf.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    want = {i: plain_parts(u) for i, u, *_ in rows}
    for r in got:
        assert (r.host, r.path) == want[r.id]
        assert r.rule == plain_rule(r.host, r.path)[0]
    assert uf.judge_urls(pages.where("false"), URL_RULES).collect() == []


def brute_split(logs, unknown, name):
    """Best over all ways to cut ``name``."""
    if not name:
        return 0.0
    best = unknown + brute_split(logs, unknown, name[:-1])
    for start in range(len(name)):
        if name[start:] in logs:
            best = max(best, logs[name[start:]] + brute_split(logs, unknown, name[:start]))
    return best


def test_words_are_the_most_likely():
    logs = {"the": -1.0, "re": -2.0, "there": -2.5, "r": -5.0, "here": -3.0, "t": -4.0, "in": -2.0}
    words = uf.Words(logs, -9.0, 8)
    for name in ("there", "therein", "thehere", "qtherex", "zz", "inre", ""):
        score = sum(logs.get(w, -9.0 * len(w)) for w in words.split(name))
        assert "".join(words.split(name)) == name
        assert abs(score - brute_split(logs, -9.0, name)) < 1e-9
    assert words.split("qqtheqq") == ["qq", "the", "qq"]


def test_bayes_learns_from_rules(spark):
    judged = spark.createDataFrame(
        [("good.org", "/fine/1", "allow")] * 20 + [("bad.org", "/ugly/2", "block")] * 20, "host string, path string, verdict string")
    words = uf.Words({"good": -1.0, "bad": -1.0, "fine": -1.0, "ugly": -1.0, "org": -1.0}, -9.0, 8)
    bayes = uf.fit_bayes(judged, words, uf.UrlFit())
    assert bayes.blocks(uf.tokens_of("badbad.org", "/ugly/77", words)) > 0 > bayes.blocks(uf.tokens_of("goodfine.org", "/x/1", words))
    none = uf.fit_bayes(judged.where("false"), words, uf.UrlFit())
    assert none.blocks(["h:bad"]) == 0
