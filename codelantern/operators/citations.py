"""Citation tags in answers: extraction, audit against retrieved chunks, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.functions.text import LINE_BREAK, trim_space

MAX_LINE = 2**63 - 1


def _line(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.lit(MAX_LINE))


def extract_citations(answers: DataFrame) -> DataFrame:
    """``(answer_id, ord, tag, file_path, start_line, end_line)``; a repeated target keeps its first tag."""
    tags = F.regexp_extract_all("text", F.lit(fv.CITATION), F.lit(0))
    tag = F.col("tag")

    def group(n: int) -> Column:
        return F.regexp_extract(tag, fv.CITATION, n)

    found = answers.select("answer_id", F.posexplode_outer(tags).alias("ord", "tag")).where(tag.isNotNull())
    last = F.when(group(3) != "", group(3)).otherwise(group(2))
    parsed = found.select(
        "answer_id", "ord", "tag", group(1).alias("file_path"),
        _line(group(2)).alias("start_line"), _line(last).alias("end_line"),
    )
    target = ["answer_id", "file_path", "start_line", "end_line"]
    return (
        parsed.groupBy(*target).agg(F.min(F.struct("ord", "tag")).alias("first"))
        .select("answer_id", "first.ord", "first.tag", "file_path", "start_line", "end_line")
    )


def snippet(content: Column, chunk_start: Column, start_line: Column, end_line: Column) -> Column:
    """The cited lines of a chunk; its first characters when the range selects nothing."""
    lines = F.split(content, LINE_BREAK)
    first = F.greatest(F.lit(0), start_line - chunk_start)
    stop = F.least(F.size(lines).cast("long"), end_line - chunk_start + 1)
    wanted = F.slice(lines, (first + 1).cast("int"), F.greatest(F.lit(0), stop - first).cast("int"))
    text = trim_space(F.array_join(wanted, "\n"))
    return F.when(F.length(text) > 0, text).otherwise(F.substring(content, 1, fv.SNIPPET_FALLBACK_CHARS))


def audit_citations(citations: DataFrame, hits: DataFrame, strict_paths: bool = False) -> DataFrame:
    """Check each citation against the chunks its answer was given.

    ``hits`` holds ``(answer_id, rank, file_path, start_line, end_line, content)``.
    A citation is valid when a chunk's path ends with the cited path and the line
    ranges overlap; the best-ranked such chunk wins.  ``strict_paths`` asks for a
    whole path component at the boundary.
    """
    c, h = citations.alias("c"), hits.alias("h")
    cited, stored = F.lower("c.file_path"), F.lower("h.file_path")
    same_path = stored.endswith(cited)
    if strict_paths:
        same_path = (stored == cited) | stored.endswith(F.concat(F.lit("/"), cited))
    overlap = (F.col("c.start_line") <= F.col("h.end_line")) & (F.col("c.end_line") >= F.col("h.start_line"))
    matched = (
        c.join(h.select("answer_id", "rank", "file_path", "start_line", "end_line").alias("h"),
               (F.col("c.answer_id") == F.col("h.answer_id")) & same_path & overlap, "left")
        .groupBy("c.answer_id", "c.ord", "c.tag", "c.file_path", "c.start_line", "c.end_line")
        .agg(F.min("h.rank").alias("rank"))
    )
    source = hits.select(
        "answer_id", "rank", F.col("file_path").alias("chunk_path"),
        F.col("start_line").alias("chunk_start"), "content",
    )
    valid = F.col("rank").isNotNull()
    text = snippet(F.col("content"), F.col("chunk_start"), F.col("start_line"), F.col("end_line"))
    return matched.join(source, ["answer_id", "rank"], "left").select(
        "answer_id", "ord", "tag",
        F.coalesce("chunk_path", "file_path").alias("file_path"), "start_line", "end_line",
        valid.alias("valid"), F.when(valid, text).alias("snippet"),
    )
