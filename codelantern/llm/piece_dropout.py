"""SentencePiece encoding with seeded merge-dropout, and its exact inverse.

A text becomes pieces of a public merge-type vocabulary: neighbours whose
joint string is a piece merge, best score first and leftmost among equals.
Each candidate merge, that is a pair of stretches of one word, is skipped when a keyed
hash of document, word and stretches falls under the dropout rate, so a
document is always cut the same way and different documents differently.  Without dropout the
pieces are the library's own; with any dropout they decode to the text.

Words of a batch are merged together in numpy, one merge of each word per
round.  Long unbroken stretches take an agenda (a heap) instead; both ways follow the same rule.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern.llm.frames import add_columns, stretches

#: How the vocabulary writes a space.
MARK = "▁"
#: Characters of a word up to which it is merged together with others.
SHORT = 48
_WORDS = re.compile(" *[^ ]+| +")
_WORD_START = re.compile("(?<! ) ")


@dataclass(frozen=True)
class Dropout:
    model: str                #: path of the vocabulary file, present on every executor
    rate: float = 0.1
    seed: int = 13


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Pieces:
    """A merge-type vocabulary: characters, bytes, and which two pieces join to which."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        text = [library.id_to_piece(i) for i in range(n)]
        plain = [not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)) for i in range(n)]
        self.ids = {text[i].replace(MARK, " "): i for i in range(n) if plain[i]}
        self.bytes = [0] * 256
        #: What each id stands for, in bytes of the decoded text.
        self.out = [b""] * n
        for i in range(n):
            if library.is_byte(i):
                value = int(text[i][3:5], 16)
                self.bytes[value], self.out[i] = i, bytes([value])
            elif plain[i]:
                self.out[i] = text[i].replace(MARK, " ").encode()
        self.n = n
        scores = np.array([library.get_score(i) for i in range(n)])
        #: Rank of the piece that a merge makes: the best score is 0, equal scores share a rank.
        self.rank = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)
        keys, made = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    made.append(i)
        order = np.argsort(keys)
        self.keys, self.made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.joins = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        # A table with open addressing: one or two looks instead of a binary search.
        self.bits = int(len(keys) * 4).bit_length()
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_made = np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(self.keys)
        self.probes = 1
        for key, value, slot in zip(self.keys.tolist(), self.made.tolist(), slots.tolist(), strict=True):
            steps = 1
            while self.slot_key[slot] >= 0:
                slot, steps = (slot + 1) & ((1 << self.bits) - 1), steps + 1
            self.slot_key[slot], self.slot_made[slot] = key, value
            self.probes = max(self.probes, steps)
        #: Words may be cut before each space mark only if no piece has one after another character.
        self.by_word = not any(re.search("[^ ] ", piece) for piece in self.ids)
        self.chars = _char_table(self)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two pieces join to, or -1; characters outside the vocabulary are -1 and join nothing."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.n + right, -2)
        slot = self._slot(keys)
        made = np.where(self.slot_key[slot] == keys, self.slot_made[slot], -1)
        open_ = np.flatnonzero((self.slot_key[slot] != keys) & (self.slot_key[slot] >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            at = self.slot_key[slot[open_]]
            hit = at == keys[open_]
            made[open_[hit]] = self.slot_made[slot[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return made


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _skipped(key, start, middle, end, rate: float):
    """Whether the merge of [start, middle) and [middle, end) in the word with ``key`` is skipped."""
    if rate <= 0:
        return np.zeros(len(key), bool)
    spans = (start.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
    return (_mix(key ^ _mix(spans + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)) < np.uint64(int(rate * (1 << 53)))


def _merge_short(pieces: Pieces, chars: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words at once.  ``chars`` is words x longest with ids; gives ids and which of them begin a piece."""
    words, width = chars.shape
    at = np.arange(width, dtype=np.int32)
    lengths = lengths.astype(np.int32)
    ids = chars.copy()
    head = at[None, :] < lengths[:, None]
    after = np.minimum(np.where(head, at + 1, width), lengths[:, None])      # where the next piece begins
    before = np.broadcast_to(at - 1, chars.shape).copy()                     # where the piece before begins
    worst = np.iinfo(np.int32).max
    rank = np.full(chars.shape, worst, np.int32)
    made = np.full(chars.shape, -1, np.int32)

    def look(row: np.ndarray, left: np.ndarray) -> None:
        middle = after[row, left]
        fits = middle < lengths[row]
        rank[row[~fits], left[~fits]] = worst
        row, left, middle = row[fits], left[fits], middle[fits]
        new = pieces.joined(ids[row, left], ids[row, middle])
        known = np.flatnonzero(new >= 0)
        rank[row, left] = worst
        if rate > 0 and len(known):
            skip = _skipped(keys[row[known]], left[known], middle[known], after[row[known], middle[known]], rate)
            known = known[~skip]
        row, left, new = row[known], left[known], new[known]
        rank[row, left], made[row, left] = pieces.rank[new], new

    row, left = np.nonzero(head)
    look(row, left)
    live = np.arange(words)
    while len(live):
        best = rank[live].argmin(axis=1)
        more = rank[live, best] < worst
        live, best = live[more], best[more]
        if not len(live):
            break
        gone = after[live, best]
        ids[live, best] = made[live, best]
        head[live, gone] = False
        rank[live, gone] = worst
        beyond = after[live, gone]
        after[live, best] = beyond
        inner = beyond < lengths[live]
        before[live[inner], beyond[inner]] = best[inner]
        look(live, best)
        front = best > 0
        look(live[front], before[live[front], best[front]])
    return ids, head


def _merge_long(pieces: Pieces, ids: list[int], key: int, rate: float) -> tuple[list[int], list[int]]:
    """One word through an agenda of candidate merges: ids of its pieces, and where they begin."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(found: list[tuple[int, int]]) -> None:
        rows = []
        for left, middle in found:
            if left >= 0 and middle < n and ids[left] >= 0 and ids[middle] >= 0:
                new = pieces.joins.get(ids[left] * pieces.n + ids[middle])
                if new is not None:
                    rows.append((left, middle, after[middle], new))
        if not rows:
            return
        spans = np.array(rows, np.int64)
        skip = _skipped(np.full(len(rows), key, np.uint64), spans[:, 0], spans[:, 1], spans[:, 2], rate).tolist()
        for (left, middle, end, new), out in zip(rows, skip, strict=True):
            if not out:
                heapq.heappush(agenda, (int(pieces.rank[new]), left, middle, end, new))

    offer([(i, i + 1) for i in range(n - 1)])
    while agenda:
        _, left, middle, end, new = heapq.heappop(agenda)
        if not (alive[left] and middle < n and alive[middle] and after[left] == middle and after[middle] == end):
            continue  # one of the two has merged since
        ids[left], alive[middle], after[left] = new, False, end
        if end < n:
            before[end] = left
        offer([(before[left], left), (left, end)])
    begins = [i for i in range(n) if alive[i]]
    return [ids[i] for i in begins], begins


def _char_table(pieces: Pieces) -> np.ndarray:
    """The id of each code point as a piece of its own: plain ASCII outside the vocabulary its byte piece, others -1."""
    table = np.full(0x110000, -1, np.int32)
    table[:128] = pieces.bytes[:128]
    for piece, i in pieces.ids.items():
        if len(piece) == 1:
            table[ord(piece)] = i
    return table


def _merged(pieces: Pieces, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
    """Merge every word of the flat ``ids`` in place; True where a piece begins."""
    head = np.ones(len(ids), bool)
    low = 1
    for width in (*(w for w in (4, 8, 12, 16, 24) if w < SHORT), SHORT):
        chosen = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        step = max(1, (1 << 18) // width)
        for at in range(0, len(chosen), step):
            part = chosen[at:at + step]
            inside = np.arange(width)[None, :] < lengths[part, None]
            flat = (starts[part, None] + np.arange(width)[None, :])[inside]
            chars = np.full(inside.shape, -1, np.int32)
            chars[inside] = ids[flat]
            new, begins = _merge_short(pieces, chars, lengths[part], keys[part], rate)
            ids[flat], head[flat] = new[inside], begins[inside]
    for word in np.flatnonzero(lengths > SHORT).tolist():
        a, b = int(starts[word]), int(starts[word] + lengths[word])
        new, begins = _merge_long(pieces, ids[a:b].tolist(), keys[word], rate)
        head[a:b] = False
        ids[a + np.array(begins)], head[a + np.array(begins)] = new, True
    return head


def encode_batch(pieces: Pieces, texts: list[str], doc_keys: np.ndarray, rate: float, seed: int,
                 room: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, offsets)``: text i has the pieces ``ids[offsets[i]:offsets[i + 1]]``, an empty text none.

    As the library does, a space is put before the text and stays out of the
    decoded one.  Characters outside the vocabulary become byte pieces, and so
    does a literal space mark, which would otherwise come back as a space.  About
    ``room`` characters are worked on at a time; long texts are cut between words.
    """
    counts, found = np.zeros(len(texts), np.int64), []
    done = np.zeros(len(texts), np.int64)
    held, owners, chars = [], [], 0

    def flush() -> None:
        nonlocal chars
        ids, ends = _encode_stretches(pieces, held, owners, done, doc_keys[owners], rate, seed)
        np.add.at(counts, owners, np.diff(ends))
        found.append(ids)
        held.clear()
        owners.clear()
        chars = 0

    for i, text in enumerate(texts):
        for part in stretches(" " + text, _WORD_START, room) if text and pieces.by_word else [" " + text] * bool(text):
            held.append(part)
            owners.append(i)
            chars += len(part)
            if chars > room:
                flush()
    if held:
        flush()
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(counts)))


def _encode_stretches(
    pieces: Pieces, texts: list[str], owners: list[int], done: np.ndarray, doc_keys: np.ndarray, rate: float, seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """``encode_batch`` for stretches of texts, none of them empty; ``done`` counts the words of each owner so far."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    firsts = np.zeros(len(texts), np.int64)
    for i, (text, owner) in enumerate(zip(texts, owners, strict=True)):
        found = _WORDS.findall(text) if pieces.by_word else [text]
        words += found
        counts[i], firsts[i] = len(found), done[owner]
        done[owner] += len(found)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    # Every word is cut by a key of its own: of its document, its place in the text and its letters.
    inside = np.arange(len(points)) - np.repeat(starts, lengths)
    word_hash = np.add.reduceat(_mix(points.astype(np.uint64) ^ (inside.astype(np.uint64) + np.uint64(1) << np.uint64(32))), starts)
    doc_hash = _mix(doc_keys.astype(np.int64).view(np.uint64) ^ _mix(np.array([seed], np.int64).view(np.uint64)))
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts - firsts, counts)
    keys = _mix(word_hash ^ _mix(np.repeat(doc_hash, counts) + place.astype(np.uint64)))
    ids = pieces.chars[points]
    head = _merged(pieces, ids, starts, lengths, keys, rate)
    sizes = head.astype(np.int64)
    strange = np.flatnonzero(head & (ids < 0))
    if len(strange):
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in points[strange].tolist()]
        sizes[strange] = [len(b) for b in spelled]
        flat = np.repeat(ids, sizes)
        to = np.repeat((np.cumsum(sizes) - sizes)[strange], sizes[strange])
        to += np.concatenate([np.arange(len(b)) for b in spelled])
        flat[to] = [pieces.bytes[x] for b in spelled for x in b]
    else:
        flat = ids[head]
    ends = np.concatenate(([0], np.cumsum(np.add.reduceat(sizes, starts))))
    return flat.astype(np.int32), ends[np.concatenate(([0], np.cumsum(counts)))]


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The text of some pieces, without the space that encoding puts first; ids out of range and control ids stand for nothing."""
    out, n = pieces.out, pieces.n
    data = b"".join([out[i] for i in ids if 0 <= i < n])
    return data.removeprefix(b" ").decode("utf-8", "replace")


def _decoded(pieces: Pieces, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([decode_ids(pieces, one.tolist()) for one in np.split(ids, ends[:-1])] if len(ends) else [], pa.string())


def encode_pieces(docs: DataFrame, spec: Dropout, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``pieces``, an array of ids; with ``decoded`` also the text that they decode to.

    Null and empty texts have no pieces.  Rows of one id are cut with one key,
    rows without an id with a key of their text.  Columns of the added names are replaced.
    """
    rate, seed, model = spec.rate, spec.seed, spec.model

    def encode(texts: pa.Array, doc_keys: pa.Array) -> list[pa.Array]:
        pieces = pieces_of(model)
        ids, offsets = encode_batch(
            pieces, [t or "" for t in texts.to_pylist()], doc_keys.to_numpy(zero_copy_only=False), rate, seed)
        rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        return [rows, _decoded(pieces, ids, offsets[1:])] if decoded else [rows]

    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.coalesce(text_col, F.lit("")))))
    return add_columns(docs, [text_col, key], encode, "pieces array<int>" + ", decoded string" * decoded)


def decode_pieces(df: DataFrame, spec: Dropout, pieces_col: str = "pieces") -> DataFrame:
    """All columns of ``df`` and ``decoded``, the text that its pieces stand for; no pieces and null give an empty text."""
    model = spec.model

    def decode(rows: pa.Array) -> list[pa.Array]:
        ids = rows.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
        return [_decoded(pieces_of(model), ids, ends)]

    return add_columns(df, [pieces_col], decode, "decoded string")
