"""Verdicts on URLs: exact host rules, then words that are split out of host names and a naive Bayes over them.

Words and their counts come from all page texts.  A host label is split into
words by the most likely sequence of them (Viterbi over unigrams); the words of
host and path are the tokens of a multinomial naive Bayes, which learns from the
pages that a rule decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern.llm.frames import map_slices, most_frequent

ALLOW, BLOCK = "allow", "block"
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class UrlFit:
    words: int = 50_000        #: most frequent words kept for splitting names, about
    tokens: int = 100_000      #: most frequent tokens kept by the classifier, about
    longest: int = 24          #: letters of the longest word
    smoothing: float = 1.0


def url_host(url: Column) -> Column:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(F.instr(url, "://") > 0, lowered), F.lit(""))


def url_path(url: Column) -> Column:
    """The path: what follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits, as text; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted({rule for _, rule in rules}, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: list[tuple[str, str]]) -> Column:
    verdict = F.lit(None).cast("string")
    for what, text in rules:
        verdict = F.when(rule == text, F.lit(what)).otherwise(verdict)
    return verdict


@dataclass
class Words:
    """Log probabilities of words, and of a letter of a word that is not among them."""

    logs: dict[str, float]
    unknown: float
    longest: int
    cache: dict[str, list[str]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def split(self, name: str) -> list[str]:
        """The most likely words of ``name``; ties go to the longer last word.  Unknown letters stay together."""
        if name in self.cache:
            return self.cache[name]
        best, last = [0.0], [0]
        for end in range(1, len(name) + 1):
            top, at = best[end - 1] + self.unknown, -1
            for start in range(max(0, end - self.longest), end):
                known = self.logs.get(name[start:end])
                if known is not None and (best[start] + known > top or at < 0 and best[start] + known >= top):
                    top, at = best[start] + known, start
            best.append(top)
            last.append(at)
        words, end, strange = [], len(name), ""
        while end:
            start = last[end]
            if start < 0:
                strange, end = name[end - 1] + strange, end - 1
                continue
            words += [strange] * bool(strange) + [name[start:end]]
            strange, end = "", start
        words = (words + [strange] * bool(strange))[::-1]
        if len(self.cache) < 100_000:
            self.cache[name] = words
        return words


def tokens_of(host: str, path: str, words: Words) -> list[str]:
    """Words of the host's labels and of the path, marked by their place; a number counts by its length."""
    found = []
    for place, text in (("h", host), ("p", path)):
        for part in _PARTS.findall(text.lower()):
            found += [f"{place}:#{len(part)}"] if part[0].isdigit() else [f"{place}:{w}" for w in words.split(part)]
    return found


def count_words(pages: DataFrame, html_col: str, spec: UrlFit) -> Words:
    """Unigram counts of all words of all pages, tags left out."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, int] = {}
        for html in batch.column(0).to_pylist():
            for word in _LETTERS.findall(re.sub(r"<[^>]*>", " ", html or "").lower()):
                if len(word) <= spec.longest:
                    counts[word] = counts.get(word, 0) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "times"])

    counts = map_slices(pages.select(html_col), work, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    kept = most_frequent(counts, "word", "times", {0: spec.words}).collect()
    total = sum(r.times for r in kept) or 1
    # A letter outside all words costs more than the rarest word, so names stay whole only where nothing fits.
    return Words({r.word: log(r.times / total) for r in kept}, log(0.1 / total), spec.longest)


@dataclass
class NaiveBayes:
    prior: float                 #: log odds of block
    odds: dict[str, float]       #: by token
    new: float                   #: of a token that was not seen

    def blocks(self, tokens: list[str]) -> float:
        """Log odds of block."""
        return self.prior + sum(self.odds.get(t, self.new) for t in tokens)


def fit_bayes(judged: DataFrame, words: Words, spec: UrlFit) -> NaiveBayes:
    """Learn from ``judged(host, path, verdict)``: token counts of all its rows, summed per task before they travel.

    Without rows the odds are even.
    """
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, str], int] = {}
        for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for token in ["", *tokens_of(host, path, words)]:
                counts[token, verdict] = counts.get((token, verdict), 0) + 1
        return pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in counts], pa.string()), pa.array([v for _, v in counts], pa.string()),
             pa.array(list(counts.values()), pa.int64())], ["token", "verdict", "times"])

    times = lambda what: F.sum(F.when(F.col("verdict") == what, F.col("times")).otherwise(0))
    counts = (
        map_slices(judged.select("host", "path", "verdict"), work, "token string, verdict string, times long")
        .groupBy("token").agg(times(ALLOW).alias("allowed"), times(BLOCK).alias("blocked"), F.sum("times").alias("times"))
    )
    kept = most_frequent(counts, "token", "times", {0: spec.tokens + 1}).collect()
    rows = {r.token: (r.allowed, r.blocked) for r in sorted(kept, key=lambda r: r.token)}
    allowed, blocked = rows.pop("", (0, 0))
    a = spec.smoothing
    all_allowed = sum(x for x, _ in rows.values()) + a * (len(rows) + 1)
    all_blocked = sum(x for _, x in rows.values()) + a * (len(rows) + 1)
    odds = {t: log((y + a) / all_blocked) - log((x + a) / all_allowed) for t, (x, y) in rows.items()}
    return NaiveBayes(log((blocked + a) / (allowed + a)), odds, log(a / all_blocked) - log(a / all_allowed))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], spec: UrlFit = UrlFit(), id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, host, path, rule, verdict, odds)`` for every row of ``pages``.

    A rule decides where one fits; elsewhere the sign of the classifier's log odds
    of block does, with even odds allowed.  Null urls and urls without ``://`` have an empty host
    and path and are judged by the prior.  Repeated rows are judged alike; an
    empty table gives an empty result.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    parts = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    words = count_words(pages, html_col, spec)
    judged = parts.where("rule is not null").withColumn("verdict", rule_verdict(F.col("rule"), rules))
    context = pages.sparkSession.sparkContext
    held = context.broadcast((words, fit_bayes(judged, words, spec)))

    @F.pandas_udf("double")
    def odds(hosts, paths):
        import pandas as pd

        words, bayes = held.value
        return pd.Series([bayes.blocks(tokens_of(h, p, words)) for h, p in zip(hosts, paths, strict=True)], dtype=float)

    by_method = F.when(F.col("odds") > 0, BLOCK).otherwise(ALLOW)
    return (
        parts.withColumn("odds", odds("host", "path"))
        .withColumn("verdict", F.coalesce(rule_verdict(F.col("rule"), rules), by_method))
        .select("id", "host", "path", "rule", "verdict", "odds")
    )
