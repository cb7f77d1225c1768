"""Repository trees on a file system every executor can read.

Spark's binary file source leaves out dotfiles and names that start with an
underscore, both of which belong in a repository, so trees are walked here,
spread over the cluster by top-level folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelantern.operators.sizing import durable

LISTING = "repo_id string, root string, path string, size_bytes bigint"
_LISTED = pa.schema([
    ("repo_id", pa.string()), ("root", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("is_folder", pa.bool_())])
LISTED_ROWS = 10_000
READ_ROWS = 64
READ_BYTES = 256 * 1024 * 1024


def list_files(repos: DataFrame, skip_directories: tuple[str, ...] = ()) -> DataFrame:
    """``repos(repo_id, root)`` to one row per regular file.  Named directories are not entered.

    The entries of each root are listed first, then every folder among them is walked
    by a task of its own, so one large repository is not one task's work.  A folder
    that cannot be read fails the job: an incomplete listing would look like deleted files.
    """
    skipped = frozenset(skip_directories)
    tops = durable(_dealt(repos.select("repo_id", "root"), "repo_id").mapInArrow(
        lambda batches: _listed(batches, lambda repo: _entries(repo["root"], "", skipped, deep=False)), f"{LISTING}, is_folder boolean"))
    walked = _dealt(tops.where("is_folder").select("repo_id", "root", "path"), "repo_id", "path").mapInArrow(
        lambda batches: _listed(batches, lambda top: _entries(top["root"], top["path"], skipped, deep=True)), f"{LISTING}, is_folder boolean")
    return tops.where("not is_folder").unionByName(walked).drop("is_folder")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """A fixed number of tasks: by their few bytes the rows would be merged into one."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _entries(root: str, folder: str, skipped: frozenset[str], deep: bool) -> Iterator[tuple[str, int | None, bool]]:
    """``(path, size, is_folder)`` below one folder of a tree: all files of it, or its own files and folders."""
    def unreadable(error: OSError) -> None:
        raise error

    for place, names, files in os.walk(os.path.join(root, folder), onerror=unreadable):
        names[:] = [n for n in names if n not in skipped and not os.path.islink(os.path.join(place, n))]
        for name in files:
            full = os.path.join(place, name)
            if os.path.islink(full) or not os.path.isfile(full):
                continue
            try:
                size = os.stat(full).st_size
            except FileNotFoundError:
                continue
            yield os.path.relpath(full, root).replace(os.sep, "/"), size, False
        if not deep:
            yield from ((name, None, True) for name in names)
            return


def _listed(batches: Iterator[pa.RecordBatch], entries) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for tree in batch.to_pylist():
            for path, size, is_folder in entries(tree):
                rows.append({"repo_id": tree["repo_id"], "root": tree["root"], "path": path, "size_bytes": size, "is_folder": is_folder})
                if len(rows) >= LISTED_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_LISTED)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_LISTED)


def read_files(listing: DataFrame) -> DataFrame:
    """Add ``content`` as UTF-8; malformed bytes become U+FFFD, a vanished file gives no row, other errors fail the job.

    Files are dealt out by name, so one large repository is read by many tasks;
    the listing's sizes, not its own few bytes, decide how many.
    """
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()),
                        ("content", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.to_pylist():
                try:
                    with open(os.path.join(file.pop("root"), file["path"]), "rb") as handle:
                        rows.append({**file, "content": handle.read().decode("utf-8", "replace")})
                except FileNotFoundError:
                    continue
                if len(rows) >= READ_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    total = listing.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, total // READ_BYTES + 1)
    dealt = listing.repartition(tasks, "repo_id", "path")
    return dealt.mapInArrow(read, "repo_id string, path string, size_bytes bigint, content string")


def directory_size(repos: DataFrame) -> DataFrame:
    """Bytes of all regular files below each root, ``.git`` included."""
    return list_files(repos).groupBy("repo_id").agg(F.sum("size_bytes").alias("total_bytes"))
