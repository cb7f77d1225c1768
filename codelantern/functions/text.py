"""Column functions over paths and text.  All are built-in Spark expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelantern import fixed_values as fv

# fv.SPACE_CHARS as a regex class body; ranges match faster than single characters.
SPACE_CLASS = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
RAW_WORD_SPLIT = f"[{SPACE_CLASS}{fv.WORD_DELIMITERS}]+"
LINE_BREAK = "\r?\n"


def trim_space(text: Column) -> Column:
    """Strip every kind of white space from both ends, not only U+0020."""
    return F.btrim(text, F.lit(fv.SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return F.length(trim_space(text)) == 0


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix from the last dot of the base name; leading-dot names have none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def ancestor_dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(fv.LANGUAGE_BY_EXTENSION.items())])
    return F.try_element_at(table, extension(path))


def count_lines(text: Column) -> Column:
    return F.size(F.split(text, LINE_BREAK))


def tokenize(text: Column) -> Column:
    """Distinct code tokens in order of first appearance; NULL text has none.

    Whole words keep their dots and accents; identifiers are then split at
    case changes and anything but ``[a-z0-9_$]``.  A token needs two UTF-16
    units, so a lone supplementary character (four bytes in UTF-8) counts.
    """
    whole = F.filter(
        F.split(F.lower(text), RAW_WORD_SPLIT), lambda w: (F.length(w) > 1) | (F.octet_length(w) > 3)
    )
    # Matching runs is several times faster in Java than splitting at a negated class.
    parts = F.regexp_extract_all(
        F.lower(F.regexp_replace(text, fv.CAMEL_BOUNDARY, "$1 $2")), F.lit(fv.SUBTOKEN), F.lit(0)
    )
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.concat(whole, parts)), empty)


def embedding_text(path: Column, symbol_name: Column, symbol_type: Column, content: Column) -> Column:
    named = F.length(symbol_name) > 0
    header = F.when(
        named,
        F.concat(F.lit("| "), F.coalesce(symbol_type, F.lit("symbol")), F.lit(": "), symbol_name),
    ).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit(" "), header, F.lit("\n\n"), content)


def truncate(text: Column, limit: int = fv.MAX_CHUNK_CHARS) -> Column:
    over = F.length(text) - limit
    return F.when(
        over > 0,
        F.concat(
            F.substring(text, 1, limit),
            F.lit("\n... [truncated "), over.cast("string"), F.lit(" characters]"),
        ),
    ).otherwise(text)


def context_block(
    position: Column,
    path: Column,
    symbol_name: Column,
    symbol_type: Column,
    start_line: Column,
    end_line: Column,
    language: Column,
    content: Column,
) -> Column:
    symbol = F.when(
        F.length(symbol_name) > 0,
        F.concat(F.lit(", "), F.coalesce(symbol_type, F.lit("symbol")), F.lit(": "), symbol_name),
    ).otherwise("")
    return F.concat(
        F.lit("--- CONTEXT CHUNK #"), position.cast("string"), F.lit(" ---\n[Source: "),
        path, symbol, F.lit(", lines "), start_line.cast("string"), F.lit("-"), end_line.cast("string"),
        F.lit("]\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), truncate(content), F.lit("\n```"),
    )


def citation_link(repo_id: Column, path: Column, start_line: Column, end_line: Column) -> Column:
    tail = F.when(end_line.isNotNull() & (end_line != start_line), F.concat(F.lit("-L"), end_line.cast("string")))
    return F.concat(
        F.lit("https://github.com/"), repo_id, F.lit("/blob/main/"), path,
        F.lit("#L"), start_line.cast("string"), F.coalesce(tail, F.lit("")),
    )


def is_inventory_question(text: Column) -> Column:
    lowered = F.lower(text)
    hit = F.lit(False)
    for phrase in fv.INVENTORY_PHRASES:
        hit = hit | lowered.contains(phrase)
    return hit


def is_declined(text: Column) -> Column:
    return F.lower(text).contains(fv.DECLINED_PHRASE)


def percent_of(part: Column, total: Column) -> Column:
    return F.floor(100.0 * part / F.greatest(total, F.lit(1)) + 0.5).cast("long")
