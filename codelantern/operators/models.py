"""Answer models: an interface over prompt rows, an offline default and a chat-service adapter."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelantern import fixed_values as fv
from codelantern.config import GenerationOptions


class AnswerModel(Protocol):
    def answer(self, prompts: DataFrame, options: GenerationOptions | None = None) -> DataFrame:
        """``(query_id, system_prompt, user_prompt)`` to ``(query_id, text, model)``."""


class ExtractiveModel:
    """Cites every source line of the prompt; declines when there is none.  Runs in the JVM."""

    name = "extractive"
    source = r"(?m)^\[Source: ([^,\n]+).*, lines (\d+-\d+)\]$"

    def answer(self, prompts: DataFrame, options: GenerationOptions | None = None) -> DataFrame:
        def group(n: int):
            return F.regexp_extract_all("user_prompt", F.lit(self.source), F.lit(n))

        tags = F.zip_with(group(1), group(2), lambda path, span: F.concat(F.lit("["), path, F.lit(":"), span, F.lit("]")))
        text = F.when(F.size(tags) > 0, F.concat(F.lit("Relevant code is in "), F.array_join(tags, " ")))
        declined = "I don't know based on the provided codebase context."
        return prompts.select(
            "query_id", F.coalesce(text, F.lit(declined)).alias("text"), F.lit(self.name).alias("model")
        )


class ServiceError(RuntimeError):
    """A failed call; ``limited`` marks rate and size limits (HTTP 429 and 413)."""

    def __init__(self, message: str, limited: bool = False):
        super().__init__(message)
        self.limited = limited


Send = Callable[[str, str, str, float, int], str]


class ChatModel:
    """A chat service called from the tasks: up to three attempts, a second model on limits.

    ``send(model, system_prompt, user_prompt, temperature, max_tokens)`` returns
    the text or raises ``ServiceError``; it must be picklable.
    """

    def __init__(
        self, send: Send, options: GenerationOptions = GenerationOptions(),
        model: str = fv.ANSWER_MODEL, fallback: str = fv.ANSWER_FALLBACK_MODEL, first_delay: float = 1.0,
    ):
        self.send, self.options, self.fallback, self.first_delay = send, options, fallback, first_delay
        self.model = model

    def call(self, system_prompt: str, user_prompt: str, options: GenerationOptions | None = None) -> tuple[str, str]:
        options = options or self.options
        model, delay = options.model or self.options.model or self.model, self.first_delay
        for attempt in range(1, fv.MAX_ATTEMPTS + 1):
            try:
                text = self.send(model, system_prompt, user_prompt, options.temperature, options.max_tokens)
                return text, model
            except ServiceError as error:
                if attempt == fv.MAX_ATTEMPTS:
                    raise
                if error.limited:
                    model = self.fallback
                time.sleep(delay)
                delay *= 1.5
        raise AssertionError("unreachable")

    def answer(self, prompts: DataFrame, options: GenerationOptions | None = None) -> DataFrame:
        """Answers under ``options``; without them under those of the constructor."""
        call = self.call
        key = prompts.schema["query_id"].dataType
        schema = T.StructType([T.StructField("query_id", key), T.StructField("text", T.StringType()), T.StructField("model", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    text, model = call(row["system_prompt"], row["user_prompt"], options)
                    rows.append({"query_id": row["query_id"], "text": text, "model": model})
                yield pa.RecordBatch.from_pylist(
                    rows, pa.schema([batch.schema.field("query_id"), ("text", pa.string()), ("model", pa.string())])
                )

        return prompts.select("query_id", "system_prompt", "user_prompt").mapInArrow(run, schema)
