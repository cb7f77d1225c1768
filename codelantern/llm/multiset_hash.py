"""Fingerprints of documents that add up: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line) is hashed to a wide vector of +1 and -1, together with its
sentences, and a document is the sum of its paragraphs' vectors modulo 2^32.
So the order of paragraphs does not matter, inserting or deleting one is an
addition or a subtraction, and equal multisets have equal fingerprints;
different ones collide only if all lanes do.  Since the lanes are random signs, the
cosine of two sums estimates how much of two documents is the same.

The hash guards against chance, not against an adversary who searches for colliding sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelantern.llm.ordered import descending_blocks

#: Lanes of a vector, each modulo 2^32: 1 KiB.
LANES = 256
_SENTENCE = re.compile(r"(?<=[.!?]) +")


def _units(paragraph: str) -> Iterator[bytes]:
    yield b"p" + paragraph.encode("utf-8", "surrogatepass")
    for sentence in _SENTENCE.split(paragraph):
        yield b"s" + sentence.encode("utf-8", "surrogatepass")


def vector(text: str | None) -> np.ndarray:
    """The lanes of a text, as unsigned 32-bit numbers.  Null, empty and blank-line texts are the zero vector."""
    total, held = np.zeros(LANES, np.int64), []

    def flush():
        if held:
            signs = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, LANES // 8), axis=1)
            total[:] += 2 * np.add.reduce(signs, axis=0, dtype=np.int64) - len(held)
            held.clear()

    for paragraph in (text or "").split("\n"):
        if paragraph:
            for unit in _units(paragraph):
                held.append(blake2b(unit, digest_size=LANES // 8).digest())
                if len(held) >= 4096:
                    flush()
    flush()
    return total.astype(np.uint32)


def added(fingerprint: np.ndarray, text: str, sign: int = 1) -> np.ndarray:
    """The fingerprint after the paragraphs of ``text`` are inserted (``sign`` 1) or deleted (-1)."""
    return (fingerprint.astype(np.int64) + sign * vector(text).astype(np.int64)).astype(np.uint32)


def as_hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two fingerprints, 0 to 1; equal ones 1, a zero vector and another 0."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a.astype(np.int32).astype(np.float64), b.astype(np.int32).astype(np.float64)
    size = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, (x @ y) / size))) if size else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


FINGERPRINTS = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, with likenesses; see ``FINGERPRINTS``.

    The next document is the one that follows in descending order of ids (null
    ids last; rows sharing an id by text, null first); the last one's is the first.  A single
    document follows itself.  A null text is an empty one.  Texts move once.
    """
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # block, id, text, vector of the row that waits for its next one
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(start, 256)
                for block, guest, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    own = vector(text)
                    if before is not None and before[0] == block:
                        _, was, old, print_ = before
                        new = edited(old, text)
                        other = vector(new)
                        rows.append((was, len(old), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                                     as_hex(print_), as_hex(other), likeness(print_, other), likeness(print_, own)))
                        before = None
                    # Of a guest only the first copy matters, and nothing follows it.
                    before = None if guest else (block, key, text, own)
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_ARROW)

    return descending_blocks(docs, id_col, text_col, block_bytes).mapInArrow(run, FINGERPRINTS)


_ARROW = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
