"""A plain Python model of ranking semantics, for comparison only."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

SPACE = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def tokens(text):
    def units(word):
        return len(word.encode("utf-16-le")) // 2

    whole = [w for w in re.split(f"[{SPACE},;(){{}}\\[\\]\"']+", text.lower()) if units(w) > 1]
    split = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text).lower()
    return list(dict.fromkeys(whole + [w for w in re.split("[^a-z0-9_$]+", split) if len(w) > 1]))


def bm25(chunks, query, k=20):
    """``chunks``: dicts in store order.  Returns ``[(id, rounded score)]``."""
    tfs = []
    for c in chunks:
        tf = {}
        for field, weight in (("content", 1), ("file_path", 2), ("symbol_name", 4)):
            for t in tokens(c[field] or ""):
                tf[t] = tf.get(t, 0) + weight
        tfs.append(tf)
    n, mean = len(chunks), sum(map(len, tfs)) / len(chunks)
    scores = {}
    for t in tokens(query):
        df = sum(t in tf for tf in tfs)
        if not df:
            continue
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        for i, tf in enumerate(tfs):
            if t in tf:
                norm = 0.25 + 0.75 * len(tf) / (mean or 1)
                scores[i] = scores.get(i, 0) + idf * tf[t] * 2.2 / (tf[t] + 1.2 * norm)
    ranked = sorted(scores.items(), key=lambda item: -round(item[1], 9))[:k]
    return [(chunks[i]["id"], round(s, 4)) for i, s in ranked]


def cosine(a, b):
    if len(a) != len(b) or not a:
        return 0.0
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if na and nb else 0.0


def nearest(chunks, vector, k=20):
    scored = [(c["id"], round(cosine(c["embedding"], vector), 9)) for c in chunks if c["embedding"] is not None]
    return [i for i, _ in sorted(scored, key=lambda item: -item[1])[:k]]


def fuse(semantic, lexical, k=60):
    out = {i: [r, None] for r, i in enumerate(semantic, 1)}
    for r, i in enumerate(lexical, 1):
        out.setdefault(i, [None, None])[1] = r
    # An exact tie such as 1/64 goes up.
    def places(x):
        return float(Decimal(x).quantize(Decimal("0.00001"), ROUND_HALF_UP))

    scored = [(i, s, b, places(sum(1 / (k + r) for r in (s, b) if r))) for i, (s, b) in out.items()]
    return sorted(scored, key=lambda row: -row[3])
