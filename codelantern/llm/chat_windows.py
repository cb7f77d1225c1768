"""Conversations as training windows under a token budget, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns.  Each
span becomes a window: the system turn, the last turns before the span up to a
limit, then the span.  Only assistant texts that are new in a window are under
its loss mask, so each is a target exactly once.

Prefix sums have two levels (turn numbers in steps of ``block_turns``, then
blocks), so a conversation with very many turns is not one task's work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelantern.operators.sizing import durable

OPEN, NAMED, CLOSE = "### ", ":\n", "</turn>\n"
#: What a text may not hold and what stands for it; the escape character comes first.
TEXT_ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, ("\n", "\\n"), (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    return _replaced(text, escapes)


def unescaped(text: Column, escapes=TEXT_ESCAPES) -> Column:
    return _replaced(text, [(new, old) for old, new in reversed(escapes)])


@dataclass(frozen=True)
class ChatBudget:
    tokens: int = 512         #: of a window; only a window for a single longer turn, or one under a longer system turn, exceeds it
    history: int = 96         #: tokens of repeated turns at most
    least_span: int = 64      #: tokens left for new turns under a long system turn
    block_turns: int = 256    #: turn numbers summed at a time
    system: str = "system"
    target: str = "assistant"


def turn_tokens(role: Column, text: Column) -> Column:
    """Tokens of a turn, counted as a quarter of its formatted bytes, rounded up."""
    size = F.octet_length(role) + F.octet_length(text) + len(OPEN + NAMED + CLOSE)
    return F.ceil(size / 4).cast("long")


def chat_windows(turns: DataFrame, spec: ChatBudget = ChatBudget()) -> DataFrame:
    """``(conv_id, window, n_repeated, n_turns, tokens, formatted, loss)`` for every window.

    ``turns`` has conv_id, turn, role and text; other columns are left out.  Turns
    are ordered by turn (null first), then role, then text, and repeated rows are
    turns of their own; null roles and texts are empty, and a null conv_id is a conversation.
    ``loss`` holds (start, length) of the targets in code points of ``formatted``.  An
    empty table gives no windows.
    """
    rows = turns.select(
        F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"),
        F.coalesce(F.col("role") == spec.target, F.lit(False)).alias("target"),
        F.struct(F.floor(F.col("turn") / spec.block_turns).alias("n")).alias("block"),
    ).withColumn("tokens", turn_tokens(F.col("role"), F.col("text")))

    per_block = rows.groupBy("conv", "block").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"), F.min(F.struct("turn", "role", "text")).alias("head"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    blocks = per_block.select(
        "conv", "block", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"), F.min("head").over(whole).alias("head"),
    ).withColumn("led", F.col("head.role") == escaped(F.lit(spec.system), ROLE_ESCAPES))
    leads = blocks.select(
        "conv", "block", "tokens_before", "turns_before",
        F.when(F.col("led"), turn_tokens(F.col("head.role"), F.col("head.text"))).otherwise(0).alias("lead_tokens"))

    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        rows.withColumn("nth", F.row_number().over(inside))
        .withColumn("running", F.sum("tokens").over(inside)).join(leads, ["conv", "block"])
        .withColumn("at", F.col("turns_before") + F.col("nth"))
        # The leading system turn is in every window, so spans are cut without it.
        .withColumn("end", F.col("tokens_before") + F.col("running") - F.col("lead_tokens"))
        .withColumn("lead", (F.col("at") == 1) & (F.col("lead_tokens") > 0))
        .withColumn("start", F.when(F.col("lead"), F.lit(0)).otherwise(F.col("end") - F.col("tokens")))
        .withColumn("room", F.greatest(F.lit(spec.least_span), spec.tokens - spec.history - F.col("lead_tokens")))
        .withColumn("bucket", F.greatest(F.lit(0), F.floor((F.col("end") - 1) / F.col("room"))))
        .withColumn("crosses", ~F.col("lead") & (F.floor(F.col("start") / F.col("room")) < F.col("bucket")))
    )
    # A turn that crosses into a bucket stands alone if the bucket would be too long with it.
    bucket = Window.partitionBy("conv", "bucket")
    # Stored once: what follows reads its narrow columns several times, and its texts in the end.
    spans = durable(
        summed.withColumn("filled", F.sum(F.when(F.col("lead"), 0).otherwise(F.col("tokens"))).over(bucket))
        .withColumn("alone", F.col("crosses") & (F.col("filled") > F.col("room")))
        .withColumn("until", F.when(F.col("alone"), F.col("end")).otherwise(F.max("end").over(bucket)))
        .withColumn("window", F.col("bucket") * 2 + F.when(F.col("alone"), 0).otherwise(1))
        .select("conv", "window", "at", "role", "text", "target", "tokens", "lead",
                (~F.col("lead") & (F.col("until") - F.col("start") <= spec.history)).alias("tail"))
    )
    found = spans.groupBy("conv", "window").agg(F.min("at").alias("first"))
    found = found.withColumn("next", F.lead("window").over(Window.partitionBy("conv").orderBy("window")))
    members = "conv", "window", "at", "role", "text", "target", "tokens"
    tails = spans.where("tail").join(found.select("conv", "window", "next").where("next is not null"), ["conv", "window"])
    tails = tails.withColumn("window", F.col("next")).select(*members)
    # At most one leading system turn per conversation, wanted by each of its later windows.
    heads = spans.where("lead").select("conv", "at", "role", "text", "target", "tokens")
    heads = found.where("first > 1").select("conv", "window").join(heads, "conv").select(*members)
    parts = (
        spans.select(*members, F.lit(False).alias("repeated"))
        .unionByName(tails.withColumn("repeated", F.lit(True))).unionByName(heads.withColumn("repeated", F.lit(True)))
        .withColumn("mark", F.concat(F.lit(OPEN), "role", F.lit(NAMED)))
        .withColumn("piece", F.concat("mark", "text", F.lit(CLOSE)))
    )
    before = Window.partitionBy("conv", "window").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("from", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)))
    span = F.struct((F.col("from") + F.char_length("mark")).cast("int").alias("start"), F.char_length("text").alias("length"))
    return (
        placed.groupBy("conv", "window").agg(
            F.sum(F.col("repeated").cast("int")).alias("n_repeated"), F.count(F.lit(1)).alias("n_turns"),
            F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
            F.array_sort(F.collect_list(F.when(F.col("target") & ~F.col("repeated"), span))).alias("loss"))
        .select("conv.conv_id", "window", "n_repeated", "n_turns", "tokens",
                F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"), "loss")
    )


def read_turns(windows: DataFrame) -> DataFrame:
    """Each window's new turns, read back: ``turns`` of (role, text), and ``learned``, the texts under its mask."""
    pieces = F.split("formatted", CLOSE)
    new = F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns").cast("int") - F.col("n_repeated"))

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"^### ([^:]*):\n", 1)
        text = F.substr(piece, F.char_length(role) + F.lit(len(OPEN + NAMED) + 1))
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(text).alias("text"))

    return windows.select(
        "conv_id", "window", F.char_length("formatted").alias("formatted_chars"), F.transform(new, turn).alias("turns"),
        F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s.start + 1, s.length))).alias("learned"))
