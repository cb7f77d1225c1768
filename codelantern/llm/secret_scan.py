"""Secrets in texts: fixed patterns, and literals that end up under sensitive names.

A text is lexed where it holds an assignment sign.  Every ``name = value`` of
source and configuration syntax (also ``:``, ``:=``, ``=>``, annotations, quoted
keys) becomes a name with the literals and the names of its value.  Names refer
to other assignments of the same text, so a literal inherits the highest score
of all names that it reaches; a name's score comes from its words, a literal's
from its length, variety and likeness to a placeholder.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from codelantern.llm.frames import add_columns

#: Fixed patterns by kind, with the length that the match (of ``assign``: its value) needs; ASCII letters in either case for names.
BASE = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 24),
}
#: Kinds in the order in which spans of one start are listed.
KINDS = (*BASE, "literal", "constant")

# Words of names that hold secrets, words that make a key one, and last words that speak of something else.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.7, "authorization": 0.8, "bearer": 0.8,
}
KEY_WORDS = ("api", "access", "private", "signing", "encryption", "master", "session", "service", "account")
OTHER_THINGS = (
    "file", "path", "dir", "url", "uri", "name", "id", "length", "len", "count", "type", "field", "label", "policy", "hint",
    "header", "format", "regex", "pattern", "prefix", "placeholder", "expires", "expiry", "ttl", "env", "max", "min", "limit",
)

_SIGN = re.compile("[:=]")
_TARGET = re.compile(
    r"""(?<![\w$.-])(?P<quote>["'`]?)(?P<name>[A-Za-z_$][\w$.-]*+)(?P=quote)[ \t]*+"""
    r"""(?::[ \t]*+[A-Za-z_][\w.]*+(?:\[[\w., |]*+\])?[ \t]*+=(?![=>])|:=|=>|[:=](?![=:/]))""")
_STRING = re.compile(
    r'''[rbuf]{0,2}(?:"""(?P<a>(?:[^"\\]|\\[\s\S]|"(?!""))*+)"""|\'\'\'(?P<b>(?:[^'\\]|\\[\s\S]|'(?!''))*+)\'\'\'|'''
    r'''"(?P<c>(?:[^"\\\n]|\\[\s\S])*+)"|'(?P<d>(?:[^'\\\n]|\\[\s\S])*+)'|`(?P<e>(?:[^`\\]|\\[\s\S])*+)`)''')
_NAME = re.compile(r"\$?\{?([A-Za-z_$][\w$.]*+)\}?")
_NAME_ONLY = re.compile(r"\$?\{?[A-Za-z_$][\w$.]*+\}?(?=[\s,;)\]}+|?&#]|$)")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|#]++""")
_INSIDE = re.compile(r"\$\{([A-Za-z_]\w*)\}")
_JOINT = re.compile(r"[ \t]*+(?:\+|\|\||\?\?|\bor\b|\.\.?(?=[ \t]*+[\"'`$]))[ \t]*+\n?[ \t]*+")
_BLANK, _ANY_BLANK = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(
    r"(?i)(?:[x*.\-_#0]+|<.*>|\$[\{(].*|%\w.*|\{\{.*|(?:your|my|an?|the|example|sample|test|dummy|change.?me|insert|enter|none|null|"
    r"nil|true|false|undefined|todo|placeholder|redacted|hidden)(?:[\W_].*)?)\Z", re.S)


def name_score(name: str) -> float:
    """How likely a name of this kind holds a secret, 0 to 1; its words are split at signs and at capitals."""
    words = [w.lower() for w in _WORDS.findall(name)]
    score = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    for before, word in zip(words, words[1:], strict=False):
        if word in ("key", "keys") and before in KEY_WORDS:
            score = max(score, 0.9)
        if before == "pass" and word in ("word", "phrase"):
            score = 1.0
    return score * 0.3 if words and words[-1] in OTHER_THINGS else score


def literal_score(value: str, quoted: bool) -> float:
    """How likely a literal is a secret, 0 to 1: its information in bits, less for plain words, nothing for placeholders."""
    if len(value) < 6 or _PLACEHOLDER.match(value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n * log2(n / len(value)) for n in counts.values())
    score = min(1.0, bits / 20)
    if any(c.isspace() for c in value):
        score *= 0.4
    elif value.isalpha():
        score *= 0.7 if quoted else 0.0
    return score if quoted or any(c.isdigit() for c in value) else 0.0


@dataclass
class _Assignment:
    name: str
    score: float
    literals: list[tuple[int, int, bool]] = field(default_factory=list)   # start, end, quoted
    refs: list[int | str] = field(default_factory=list)                   # assignments before, or names met later
    words: list[tuple[str, int, int]] = field(default_factory=list)       # bare words, literals if no assignment has their name


def _value(text: str, at: int, stop: int, made: _Assignment, known: dict[str, int]) -> int:
    """Read the value at ``at`` into ``made``: literals and names, joined or as arguments of a call; returns its end."""
    depth, first = 0, True
    while at < len(text):
        at = (_ANY_BLANK if depth else _BLANK).match(text, at).end()
        string = _STRING.match(text, at)
        if string:
            inner = string.lastgroup
            made.literals.append((*string.span(inner), True))
            made.refs += [known.get(n, n) for n in _INSIDE.findall(string[inner])]
            at = string.end()
        elif text.startswith("(", at):
            depth, at = depth + 1, at + 1
            continue
        elif _NAME_ONLY.match(text, at) or (name := _NAME.match(text, at)) and text.startswith("(", name.end()):
            name = _NAME.match(text, at)
            at = name.end()
            if text.startswith("(", at):
                depth, at = depth + 1, at + 1
                continue
            made.refs.append(known.get(name[1], name[1]))
            if not depth and not text.startswith("$", name.start()):
                made.words.append((name[1], *name.span(1)))
        elif (bare := _BARE.match(text, at)) and (first or depth):
            if not depth:
                made.literals.append((at, bare.end() - (bare[0][-1] in ".:"), False))
            at = bare.end()
        elif depth == 0:
            return at
        first = False
        while depth and (at := _ANY_BLANK.match(text, at).end()) < len(text) and text[at] == ")":
            depth, at = depth - 1, at + 1
        joint = _JOINT.match(text, at)
        if joint:
            at = joint.end()
        elif depth and text.startswith(",", at):
            at += 1
        elif not _STRING.match(text, _BLANK.match(text, at).end()):  # strings side by side are one literal
            return at
    return at


def _lines(text: str) -> Iterator[tuple[int, int]]:
    """Lines that hold an assignment sign."""
    at = 0
    while found := _SIGN.search(text, at):
        end = text.find("\n", found.end())
        end = len(text) if end < 0 else end
        yield text.rfind("\n", 0, found.start()) + 1, end
        at = end


def _reached(made: list[_Assignment], known: dict[str, int]) -> Iterator[tuple[int, float, bool]]:
    """Assignments with the highest score of the names they flow into, and whether it is their own name's."""
    seen = [False] * len(made)
    for top in sorted((i for i, a in enumerate(made) if a.score), key=lambda i: (-made[i].score, i)):
        waiting, own = [top], True
        while waiting:
            at = waiting.pop()
            if not seen[at]:
                seen[at] = True
                yield at, made[top].score, own
                waiting += [r for r in (known.get(r, -1) if isinstance(r, str) else r for r in made[at].refs) if r >= 0]
            own = False


def secrets_of(text: str, least: float = 0.5) -> list[dict]:
    """All spans of a text by start, then kind: ``kind, start, end`` (code points, exclusive), ``name`` and ``score``.

    Base kinds have no score of their own (1.0) and always stay; a literal inside one of them is not told again.
    """
    found: list[dict] = []
    made: list[_Assignment] = []
    known: dict[str, int] = {}
    pattern, room = BASE["assign"]
    read_until = 0
    for start, end in _lines(text):
        for m in pattern.finditer(text, start, end):  # no match crosses a line or lacks the sign
            if m.end(1) - m.start(1) >= room:
                found.append({"kind": "assign", "start": m.start(), "end": m.end(), "name": m[0][:m.start(1) - m.start()].rstrip("\"' :="), "score": 1.0})
        at = max(start, read_until)
        while at < end and (m := _TARGET.search(text, at, end)):
            one = _Assignment(m["name"], name_score(m["name"]))
            at = max(m.end(), _value(text, m.end(), end, one, known))
            if one.literals or one.refs:
                made.append(one)
                known[m["name"]] = len(made) - 1
        read_until = max(read_until, at)
    for kind in ("access", "hex"):
        pattern, room = BASE[kind]
        found += [{"kind": kind, "start": m.start(), "end": m.end(), "name": None, "score": 1.0}
                  for m in pattern.finditer(text) if m.end() - m.start() >= room]
    found.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    starts, reach = [s["start"] for s in found], []
    for s in found:
        reach.append(max(s["end"], reach[-1] if reach else 0))
    told: set[tuple[int, int]] = set()
    for at, score, own in _reached(made, known):
        bare = [(start, end, False) for word, start, end in made[at].words if word not in known]
        for start, end, quoted in made[at].literals + bare:
            before = bisect_right(starts, start)
            if (start, end) in told or (before and reach[before - 1] >= end):
                continue
            total = score * literal_score(text[start:end], quoted)
            if total >= least:
                told.add((start, end))
                found.append({"kind": "literal" if own else "constant", "start": start, "end": end, "name": made[at].name, "score": round(total, 6)})
    return sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"])))


_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secrets``, the spans of each whole text by start, then kind.

    A null or empty text has none; repeated rows are rows of their own, and a
    column called ``secrets`` is replaced.  A text is lexed in one pass in the task that
    reads it, nothing is shuffled.
    """

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([secrets_of(t.as_py() or "", least) for t in texts], _SPANS)]

    return add_columns(docs, [text_col], work, "secrets array<struct<kind: string, start: int, end: int, name: string, score: double>>")
