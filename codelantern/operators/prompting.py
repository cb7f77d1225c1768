"""Prompt building: context blocks under a character budget, file inventory, assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.functions.text import context_block
from codelantern.operators.summaries import capped_inventory

SYSTEM_PROMPT = """You explain software repositories. Work under these rules:
- Use nothing but the file inventory and the context chunks you are given; no outside knowledge.
- Take answers about file names, file counts and folders from the file inventory.
- Put a tag [filePath:startLine-endLine] or [filePath:startLine] after every statement you make.
- Copy paths and line numbers from the context as they are; never make one up.
- When the context does not hold the answer, reply: "I don't know based on the provided codebase context."
"""

#: Ends every user prompt.
PROMPT_REMINDER = (
    "Before you answer: tag each statement with its [filePath:startLine-endLine], take counts and folders from the "
    "inventory above, and decline in the given words where the context falls short."
)


def context_blocks(hits: DataFrame, max_chars: int = fv.MAX_CONTEXT_CHARS) -> DataFrame:
    """``(query_id, rank, cum_chars, block)`` for the leading hits that fit the budget.

    ``hits`` are full chunk rows with ``rank`` 1, 2, ...  Lengths are positive,
    so a running sum under the budget is exactly the prefix before the first overflow.
    """
    c = F.col
    block = context_block(
        c("rank"), c("file_path"), c("symbol_name"), c("symbol_type"),
        c("start_line"), c("end_line"), c("language"), c("content"),
    )
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hits.select("query_id", "rank", block.alias("block"))
        .withColumn("cum_chars", F.sum(F.length("block")).over(running))
        .where(c("cum_chars") <= max_chars)
        .select("query_id", "rank", "cum_chars", "block")
    )


def inventory_blocks(chunks: DataFrame, limit: int = fv.MAX_INVENTORY_FILES) -> DataFrame:
    """``(repo_id, inventory)``: the formatted file list of each repository (at most ``limit`` names)."""
    listed = capped_inventory(chunks, limit).groupBy("repo_id").agg(
        F.first("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("position", "file_path"))).alias("files"),
    )
    names = F.array_join(F.transform("files", lambda f: F.concat(F.lit("- "), f["file_path"])), "\n")
    total, over = F.col("total").cast("string"), F.col("total") - limit
    rest = F.when(over > 0, F.concat(F.lit("\n... [truncated "), over.cast("string"), F.lit(" files]"))).otherwise("")
    return listed.select(
        "repo_id",
        F.concat(
            F.lit("--- REPOSITORY FILE INVENTORY ("), F.col("repo_id"), F.lit(") ---\nTotal Ingested Files ("),
            total, F.lit(" files):\n"), names, rest, F.lit("\n\n"),
        ).alias("inventory"),
    )


def user_prompts(questions: DataFrame, hits: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(query_id, user_prompt)`` for every question, with or without hits."""
    packed = context_blocks(hits).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks"),
    )
    joined = F.coalesce(F.array_join(F.col("blocks.block"), "\n\n"), F.lit(""))
    return (
        questions.select("query_id", "repo_id", "text")
        .join(packed, "query_id", "left").join(inventory, "repo_id", "left")
        .select(
            "query_id",
            F.concat(
                F.lit("USER QUESTION:\n"), F.col("text"), F.lit("\n\n"),
                F.coalesce("inventory", F.lit("")),
                F.lit("CONTEXT CHUNKS ("), F.coalesce("n", F.lit(0)).cast("string"),
                F.lit(" relevant snippet(s) from repository):\n"), joined,
                F.lit("\n\n" + PROMPT_REMINDER),
            ).alias("user_prompt"),
        )
    )
