"""Hybrid retrieval of a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern.config import SearchOptions
from codelantern.operators.fusion import confidence, fuse, retrieval_stats, top_hits
from codelantern.operators.lexical import LexicalIndex, bm25_search
from codelantern.operators.semantic import semantic_search
from codelantern.operators.sizing import durable, hinted, is_small, only_repos, row_bytes


@dataclass(frozen=True)
class Retrieval:
    fused: DataFrame
    hits: DataFrame
    confidence: DataFrame
    stats: DataFrame


def locate(hits: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """Attach the chunk columns.  Rankings carry ids only, so text is read for the winners alone."""
    stored = chunks.drop("embedding", "ord")
    return hinted(hits, small).join(stored, ["repo_id", "id"])


def hybrid_retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame | None = None,
    options: SearchOptions = SearchOptions(),
) -> Retrieval:
    """``questions(query_id, repo_id, text, vector)`` against ``chunks``.

    ``vectors`` may name a narrower ``(repo_id, id, ord, embedding)`` table; by
    default the embeddings of ``chunks`` are used.  The fused ranking, at most
    ``2 * top_k`` ids per question, is stored once: all parts of the result read it.
    """
    chunks = only_repos(chunks, questions, options)
    semantic = semantic_search(chunks if vectors is None else vectors, questions, options)
    lexical = bm25_search(index, questions, options)
    fused = durable(fuse(semantic, lexical, options))
    hits = top_hits(fused, options)
    small = is_small(hits, options, row_bytes(hits))
    places = hinted(hits.where(F.col("rank") == 1).select("repo_id", "id").distinct(), small).join(
        chunks.select("repo_id", "id", "file_path", "start_line"), ["repo_id", "id"]
    )
    return Retrieval(
        fused=fused,
        hits=locate(hits, chunks, small),
        confidence=confidence(questions, hits, places),
        stats=retrieval_stats(questions, fused),
    )
