"""Language of a text: word-first scores that back off to character n-grams.

A word that the model knows adds its log frequency in each language.  An
unknown word adds the mean log frequency of its longest n-grams of which at
least one is known, shorter ones being tried only when all longer ones are new.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern.llm.frames import add_columns, hash_share, map_slices, most_frequent, stretches

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s")


@dataclass(frozen=True)
class LanguageFit:
    """Bounds of what is learned; everything else covers all rows."""

    docs_per_lang: int = 2000   #: expected documents per language in the sample that is learned from
    words: int = 60_000         #: most frequent words kept, about
    grams: int = 20_000         #: most frequent n-grams kept of each length, about
    longest: int = 5            #: characters of the longest n-gram
    smoothing: float = 0.5


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; signs that are numbers but no letters do not make a word."""
    return [w for w in _WORD.findall((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def grams_of(word: str, n: int) -> list[str]:
    """Its character n-grams, with marks for both ends (single characters go without)."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


@dataclass
class LanguageModel:
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: list[tuple[dict[str, int], np.ndarray]]   #: longest first
    met: np.ndarray | None = None                    #: which words were met in which language; None: all in all
    room: int = 1 << 20                              #: numbers that the cache of word scores may hold
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)
    spoken: list[set[str]] | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "scores": None, "spoken": None}

    def known(self, words: list[str], lang: int) -> int:
        """How many of the words were met in the texts of a language."""
        if self.spoken is None:
            self.spoken = [{w for w, i in self.words.items() if self.met is None or self.met[i, j]} for j in range(len(self.langs))]
        return sum(map(self.spoken[lang].__contains__, words))

    def backed_off(self, words: list[str]) -> np.ndarray:
        """A row of scores for each unknown word; zeros for one without any known n-gram."""
        out, open_ = np.zeros((len(words), len(self.langs))), range(len(words))
        for n, (known, scores) in zip(range(len(self.grams), 0, -1), self.grams, strict=True):
            flat, counts, found, left = [], [], [], []
            for i in open_:
                at = [known[g] for g in grams_of(words[i], n) if g in known]
                if at:
                    flat += at
                    counts.append(len(at))
                    found.append(i)
                else:
                    left.append(i)
            if found:
                size = np.array(counts)
                out[found] = np.add.reduceat(scores[flat], np.cumsum(size) - size) / size[:, None]
            open_ = left
        return out

    def totals(self, words: list[str]) -> np.ndarray:
        if self.scores is None:
            rows = max(len(self.words) + 8192, self.room // max(1, len(self.langs)))
            self.scores = np.zeros((rows, len(self.langs)))
            self.scores[: len(self.words)] = self.word_scores
            self.cache = dict(self.words)
        cache, total = self.cache, np.zeros(len(self.langs))
        for start in range(0, len(words), 4096):
            part = words[start:start + 4096]
            if len(cache) + len(part) > len(self.scores):
                cache.clear()
                cache.update(self.words)
            new = [w for w in set(part) if w not in cache]
            self.scores[len(cache):len(cache) + len(new)] = self.backed_off(new)
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            total += self.scores[list(map(cache.__getitem__, part))].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the likelihood (ties: the first by name); ``und`` without letters."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The prediction, and the share of the text's words that texts of this language had.

        The share of the likelihood is near 1 for any long text, also in a language that was not learned; the
        share of known words tells such texts apart, whatever their length.
        """
        total, n, words = None, 0, []
        for part in stretches(text or "", _GAP, 1 << 20):
            words = words_of(part)
            if words:
                total, n = self.totals(words) + (0.0 if total is None else total), n + len(words)
        if total is None or not self.langs:
            return UNDETERMINED, 0.0, 0.0
        best = int(np.argmax(total))
        known = self.known(words, best) if n == len(words) else sum(
            self.known(words_of(part), best) for part in stretches(text, _GAP, 1 << 20))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum()), known / n


def _count_grams(longest: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[tuple[str, int, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word in words_of(text):
                key = (lang, 0, word)
                counts[key] = counts.get(key, 0) + 1
        for (lang, _, word), times in list(counts.items()):
            for n in range(1, longest + 1):
                for gram in grams_of(word, n):
                    key = (lang, n, gram)
                    counts[key] = counts.get(key, 0) + times
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
             pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["lang", "n", "gram", "times"])

    return work


def fit_languages(docs: DataFrame, learn: Column, spec: LanguageFit = LanguageFit(), id_col: str = "doc_id",
                  text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows where ``learn`` holds and the language is not null.

    Each language is learned from a sample of about ``docs_per_lang`` documents,
    fixed by a hash of id and language.  Without such rows the model knows no language.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        hash_share(id_col, lang_col).alias("share"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0)), [])
    rate = docs.sparkSession.createDataFrame(
        [(lang, min(1.0, spec.docs_per_lang / n)) for lang, n in sizes.items()], "lang string, rate double")
    sample = rows.join(F.broadcast(rate), "lang").where("share < rate").select("lang", "text")
    per_gram = (
        map_slices(sample, _count_grams(spec.longest), "lang string, n int, gram string, times long")
        .groupBy("n", "gram", "lang").agg(F.sum("times").alias("times"))
        .groupBy("n", "gram").agg(F.sum("times").alias("total"), F.collect_list(F.struct("lang", "times")).alias("by_lang"))
    )
    room = {0: spec.words} | dict.fromkeys(range(1, spec.longest + 1), spec.grams)
    kept = most_frequent(per_gram, "gram", "total", room, "n").select("n", "gram", "total", "by_lang").collect()
    langs = sorted(sizes)
    place = {lang: i for i, lang in enumerate(langs)}

    def table(n: int) -> tuple[dict[str, int], np.ndarray]:
        rows = sorted((r for r in kept if r.n == n), key=lambda r: (-r.total, r.gram))
        counts = np.full((len(rows), len(langs)), spec.smoothing)
        for i, row in enumerate(rows):
            for one in row.by_lang:
                counts[i, place[one.lang]] += one.times
        return {r.gram: i for i, r in enumerate(rows)}, counts

    def logs(counts: np.ndarray) -> np.ndarray:
        return np.log(counts / counts.sum(axis=0)) if len(counts) else counts

    words, counts = table(0)
    grams = [(known, logs(c)) for known, c in (table(n) for n in range(spec.longest, 0, -1))]
    return LanguageModel(langs, words, logs(counts), grams, counts > spec.smoothing)


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``score``, ``known`` (0 to 1), one row for each; columns of those names are replaced.

    ``known`` is the share of a text's words that the learned texts of its language had.  Null
    texts and texts without a letter are ``und`` with score and ``known`` 0.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> list[pa.Array]:
        langs, scores, known = zip(*(handle.value.judge(text) for text in texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]

    return add_columns(docs, [text_col], predict, "lang_pred string, score double, known double")
