"""File selection: directory pruning and the ordered predicate chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelantern import fixed_values as fv
from codelantern.config import FilterConfig
from codelantern.functions.text import ancestor_dirs, basename, extension

MIB = 1024.0 * 1024.0


def in_ignored_directory(path: Column, config: FilterConfig = FilterConfig()) -> Column:
    if not config.ignored_directories:
        return F.lit(False)
    return F.arrays_overlap(ancestor_dirs(path), F.array(*[F.lit(d) for d in config.ignored_directories]))


def exclusion_reason(path: Column, size_bytes: Column, config: FilterConfig = FilterConfig()) -> Column:
    """Why a file is left out, or NULL when it is taken.  The first rule that applies decides."""
    name, ext = basename(path), extension(path)
    allowed = (
        ext.isin(*config.allowed_code_extensions)
        | name.isin(*config.allowed_doc_filenames)
        | ext.isin(*config.allowed_doc_extensions)
    )
    too_big = F.format_string("File size exceeds cap (%.1f MB)", size_bytes / MIB)
    return (
        F.when(name.isin(*config.ignored_filenames), fv.REASON_FILENAME)
        .when(path.contains(".min."), fv.REASON_MINIFIED)
        .when(ext.isin(*config.ignored_extensions), fv.REASON_EXTENSION)
        .when(size_bytes.isNull(), fv.REASON_UNREADABLE)
        .when(size_bytes > config.max_file_size_bytes, too_big)
        .when(allowed, F.lit(None).cast("string"))
        .otherwise(fv.REASON_NOT_ALLOWED)
    )


def select_files(files: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """Rows of ``files`` that take part in ingestion.  Needs ``path`` and ``size_bytes``."""
    path = F.col("path")
    return files.where(~in_ignored_directory(path, config)).where(
        exclusion_reason(path, F.col("size_bytes"), config).isNull()
    )
