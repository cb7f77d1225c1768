"""Grounded answers for a batch of questions, with at most one reference hop each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.config import GenerationOptions, SearchOptions
from codelantern.functions.text import is_declined, is_inventory_question
from codelantern.operators.citations import audit_citations, extract_citations
from codelantern.operators.lexical import LexicalIndex
from codelantern.operators.models import AnswerModel, ExtractiveModel
from codelantern.operators.prompting import SYSTEM_PROMPT, inventory_blocks, user_prompts
from codelantern.operators.references import (
    append_hits,
    first_unretrieved,
    reference_lookup,
    unretrieved_references,
)
from codelantern.operators.sizing import durable, is_small, only_repos, row_bytes
from codelantern.plans.retrieve import hybrid_retrieve, locate


@dataclass(frozen=True)
class Answers:
    """``answers(query_id, text, low_confidence, reason, multi_hop, model)``, their citations and chunks."""

    answers: DataFrame
    citations: DataFrame
    hits: DataFrame


def prompt_rows(questions: DataFrame, hits: DataFrame, inventory: DataFrame) -> DataFrame:
    return user_prompts(questions, hits, inventory).withColumn("system_prompt", F.lit(SYSTEM_PROMPT))


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    index: LexicalIndex,
    model: AnswerModel | None = None,
    vectors: DataFrame | None = None,
    search: SearchOptions = SearchOptions(),
    generation: GenerationOptions = GenerationOptions(),
) -> Answers:
    """Retrieve, gate, ask, follow one missing symbol, ask again, audit.

    Rankings and model outputs are stored in the cluster's checkpoint folder: each
    is used several times, and a model must be asked once per prompt.
    """
    model = model or ExtractiveModel()
    chunks = only_repos(chunks, questions, search)
    found = hybrid_retrieve(questions, chunks, index, vectors, search)
    hits = durable(found.hits)
    judged = durable(questions.select("query_id", "repo_id", "text").join(found.confidence, "query_id"))
    is_listing = is_inventory_question(F.col("text"))
    refused = judged.where(F.col("low_confidence") & ~is_listing)
    asked = judged.where(~F.col("low_confidence") | is_listing)

    inventory = durable(inventory_blocks(chunks))
    first = durable(model.answer(prompt_rows(asked, hits, inventory), generation))

    active, final = hits, first.withColumn("multi_hop", F.lit(False))
    wanted = None
    if generation.allow_multi_hop:
        by_answer = hits.withColumnRenamed("query_id", "answer_id")
        open_answers = first.join(asked.where(~is_listing).select("query_id", "repo_id"), "query_id")
        missing = first_unretrieved(
            unretrieved_references(open_answers.select(F.col("query_id").alias("answer_id"), "text"), by_answer)
        ).withColumnRenamed("answer_id", "query_id")
        wanted = durable(missing.join(asked.select("query_id", "repo_id"), "query_id"))
    if wanted is not None and not wanted.isEmpty():
        extra = durable(reference_lookup(index, chunks, wanted, fv.HOP_TOP_K, search))
        placed = append_hits(hits, extra).join(judged.select("query_id", "repo_id"), "query_id")
        active = durable(locate(placed, chunks, is_small(placed, search, row_bytes(placed))))
        hopped = extra.select("query_id").distinct()
        again = asked.join(hopped, "query_id", "left_semi")
        second = durable(model.answer(prompt_rows(again, active, inventory), generation))
        final = (
            first.join(hopped, "query_id", "left_anti").withColumn("multi_hop", F.lit(False))
            .unionByName(second.withColumn("multi_hop", F.lit(True)))
        )

    declined = is_declined(F.col("text"))
    answered = final.join(asked.select("query_id", F.col("reason").alias("signal")), "query_id").select(
        "query_id", "text", declined.alias("low_confidence"),
        F.when(declined, fv.DECLINED_REASON).otherwise(F.col("signal")).alias("reason"), "multi_hop", "model",
    )
    gated = refused.select(
        "query_id", F.lit(fv.REFUSAL_TEXT).alias("text"), F.lit(True).alias("low_confidence"), "reason",
        F.lit(False).alias("multi_hop"), F.lit(generation.model or fv.ANSWER_MODEL).alias("model"),
    )
    audited = audit_citations(
        extract_citations(answered.select(F.col("query_id").alias("answer_id"), "text")),
        active.withColumnRenamed("query_id", "answer_id"),
    )
    return Answers(answered.unionByName(gated), audited, active)


def answers_as_json(result: Answers) -> DataFrame:
    """One response envelope per question: ``(query_id, body)``.  Values that do not exist are null in it."""
    cited = result.citations.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("valid"), F.struct("ord", "file_path", "start_line", "end_line", "snippet")))).alias("valid"),
        F.array_sort(F.collect_list(F.when(~F.col("valid"), F.struct("ord", "tag")))).alias("invalid"),
    )
    given = result.hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "id", "repo_id", "file_path", "language", "content", "start_line", "end_line", "symbol_name", "symbol_type",
        "rrf_score", "source", "semantic_rank", "bm25_rank"))).alias("given"))
    joined = result.answers.join(cited, F.col("query_id") == F.col("answer_id"), "left").join(given, "query_id", "left")
    chunks = F.transform(F.coalesce("given", F.array()), lambda h: F.struct(
        F.struct(
            h["id"].alias("id"), h["repo_id"].alias("repoId"), h["file_path"].alias("filePath"), h["language"].alias("language"),
            h["content"].alias("content"), h["start_line"].alias("startLine"), h["end_line"].alias("endLine"),
            h["symbol_name"].alias("symbolName"), h["symbol_type"].alias("symbolType")).alias("chunk"),
        h["rrf_score"].alias("score"), h["source"].alias("source"), h["semantic_rank"].alias("semanticRank"), h["bm25_rank"].alias("bm25Rank"),
    ))
    citations = F.transform(
        F.coalesce("valid", F.array()),
        lambda c: F.struct(
            c["file_path"].alias("filePath"), c["start_line"].alias("startLine"),
            c["end_line"].alias("endLine"), c["snippet"].alias("snippet"),
        ),
    )
    body = F.struct(
        F.lit(True).alias("success"),
        F.struct(
            F.col("text"), citations.alias("citations"),
            F.coalesce(F.col("invalid.tag"), F.array().cast("array<string>")).alias("invalidCitations"), chunks.alias("retrievedChunks"),
            F.col("low_confidence").alias("lowConfidence"), F.col("reason").alias("confidenceReason"),
            F.col("multi_hop").alias("multiHopTriggered"), F.col("model"),
        ).alias("answer"),
    )
    return joined.select("query_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
