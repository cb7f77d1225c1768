"""Embedding columns: an interface, the offline default and a local ONNX model."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.config import EmbeddingSettings
from codelantern.functions.text import embedding_text
from codelantern.functions.vectors import token_slots
from codelantern.operators.blocks import in_parts
from codelantern.operators.models import ServiceError


class Embedder(Protocol):
    dimension: int

    def embed(self, text: Column) -> Column:
        """``array<float>`` vector of each text."""


def unit_sums(slots: pa.Array, dim: int) -> pa.Array:
    """The unit vector of each row's packed slots.  Batches are counted in rows, whose texts may be long, so they are added up in parts."""

    def units(part: pa.Array) -> np.ndarray:
        counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        packed = part.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(part)), counts)
        signs = 1.0 - 2.0 * (packed % 2)
        cells = np.bincount(rows * dim + packed // 2, weights=signs, minlength=len(part) * dim)
        matrix = cells.astype("float64").reshape(len(part), dim)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        return np.divide(matrix, norms, out=matrix, where=norms > 0).astype("float32").ravel()

    parts = in_parts(pa.RecordBatch.from_arrays([slots], ["slots"]), "slots")
    flat = np.concatenate([np.zeros(0, "float32"), *(units(part.column(0)) for part in parts)])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype="int32") * dim), pa.array(flat))


class HashingEmbedder:
    """Deterministic token vector: tokens are hashed in the JVM, the counts added up per Arrow batch."""

    def __init__(self, dimension: int = fv.LOCAL_EMBEDDING_DIM):
        self.dimension = dimension

    def embed(self, text: Column) -> Column:
        dim = self.dimension

        @F.arrow_udf("array<float>")
        def add_up(slots: pa.Array) -> pa.Array:
            return unit_sums(slots, dim)

        return add_up(token_slots(text, dim))


class ModelEmbedder:
    """A sentence model run inside the tasks.

    ``load`` is called once per Python worker and returns ``texts -> matrix``;
    ``onnx_sentence_model`` builds one from files every executor can read.
    """

    def __init__(
        self, load: Callable[[], Callable[[list[str]], np.ndarray]],
        dimension: int = fv.LOCAL_EMBEDDING_DIM, batch_size: int = fv.LOCAL_BATCH,
    ):
        self.load, self.dimension, self.batch_size = load, dimension, batch_size

    def embed(self, text: Column) -> Column:
        load, size = self.load, self.batch_size

        @F.arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = load()
            for batch in batches:
                texts = batch.to_pylist()
                rows: list = []
                for at in range(0, len(texts), size):
                    rows.extend(np.asarray(model(texts[at:at + size]), dtype="float32").tolist())
                yield pa.array(rows, pa.list_(pa.float32()))

        return run(text)


def pooled_windows(
    windows: list[list[tuple[list[int], list[int]]]], hidden: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> np.ndarray:
    """Unit vectors of texts given as windows of (ids, types): the mean over the tokens of all windows of a text.

    ``hidden`` takes ids, mask and types of windows padded to one length.  A text without tokens is zero.
    """
    flat = [w for text in windows for w in text]
    owner = np.repeat(np.arange(len(windows)), [len(text) for text in windows])
    longest = max((len(ids) for ids, _ in flat), default=0)
    ids, mask, types = (np.zeros((len(flat), longest), "int64") for _ in range(3))
    for row, (tokens, kinds) in enumerate(flat):
        ids[row, :len(tokens)], mask[row, :len(tokens)], types[row, :len(tokens)] = tokens, 1, kinds
    states = hidden(ids, mask, types)
    sums = np.zeros((len(windows), states.shape[-1]))
    np.add.at(sums, owner, (states * mask[:, :, None]).sum(axis=1))
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)


def onnx_sentence_model(directory: str, max_tokens: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Mean-pooled, unit-length sentence vectors from ``model.onnx`` and ``tokenizer.json``.

    A text of more than ``max_tokens`` tokens is read in windows of that many.
    """

    def load() -> Callable[[list[str]], np.ndarray]:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(f"{directory}/model.onnx", providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(f"{directory}/tokenizer.json")
        tokenizer.enable_truncation(max_tokens)
        tokenizer.no_padding()
        wanted = {node.name for node in session.get_inputs()}

        def hidden(ids: np.ndarray, mask: np.ndarray, types: np.ndarray) -> np.ndarray:
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": types}
            return session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]

        def run(texts: list[str]) -> np.ndarray:
            encoded = tokenizer.encode_batch(texts)
            return pooled_windows([[(w.ids, w.type_ids) for w in (e, *e.overflowing)] for e in encoded], hidden)

        return run

    return load


class ServiceEmbedder(ModelEmbedder):
    """An embedding service called from the tasks in small batches.

    ``send(model, texts)`` returns one vector per text or raises ``ServiceError``,
    whose message may suggest a delay.  On a rate limit the second model takes
    over at once; other failures wait, doubling up to 30 seconds.
    """

    def __init__(
        self, send: Callable[[str, list[str]], list[list[float]]], model: str, fallback: str,
        dimension: int = fv.CLOUD_EMBEDDING_DIM, batch_size: int = fv.CLOUD_BATCH, first_delay: float = 2.0,
    ):
        def call(texts: list[str]) -> np.ndarray:
            current, delay = model, first_delay
            for attempt in range(1, fv.MAX_ATTEMPTS + 1):
                try:
                    return np.asarray(send(current, texts), dtype="float32")
                except ServiceError as error:
                    if attempt == fv.MAX_ATTEMPTS:
                        raise
                    if error.limited and current != fallback:
                        current = fallback
                        continue
                    time.sleep(suggested_delay(str(error), delay))
                    delay = min(delay * 2, 30.0)
            raise AssertionError("unreachable")

        super().__init__(lambda: call, dimension, batch_size)


def suggested_delay(message: str, default: float) -> float:
    """Seconds a service asks to wait (plus half a second, at most a minute), or ``default``."""
    match = re.search(r'(?:"retryDelay":\s*"|retry in )([\d.]+)s', message, re.IGNORECASE)
    try:
        seconds = float(match.group(1)) if match else 0.0
    except ValueError:
        seconds = 0.0
    return min(math.ceil(seconds * 1000) / 1000 + 0.5, 60.0) if seconds > 0 else default


def embedder_for(settings: EmbeddingSettings, send: Callable[[str, list[str]], list[list[float]]] | None = None) -> Embedder:
    """The embedder that the settings name; the cloud service needs ``send``."""
    if settings.provider == "local":
        return HashingEmbedder(settings.dimension)
    if send is None:
        raise ValueError("the cloud embedding needs a function that sends texts to it")
    return ServiceEmbedder(send, settings.model, settings.fallback, settings.dimension, settings.batch_size)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Add ``embedding`` over the text enriched with path and symbol."""
    text = embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbol_type"), F.col("content"))
    return chunks.withColumn("embedding", embedder.embed(text))


def embed_questions(questions: DataFrame, embedder: Embedder) -> DataFrame:
    return questions.withColumn("vector", embedder.embed(F.col("text")))
