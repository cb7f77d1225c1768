"""Measured size checks: nothing is broadcast on a guess."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelantern.config import SearchOptions

# Splits that any scan is given at least, while it has fewer than the cores.
SPREAD_SPLITS = 64
# Read when a write begins.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def row_bytes(df: DataFrame) -> Column:
    """The bytes that a row of flat columns takes when it is sent."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        total = total + (F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8))
    return total


def is_small(df: DataFrame, options: SearchOptions, nbytes: Column) -> bool:
    """True when ``df`` is measured to stay under the broadcast limits.

    ``nbytes`` gives the size of one row.  The measuring job stops after
    ``broadcast_rows + 1`` rows.
    """
    head = df.select(nbytes.cast("long").alias("n")).limit(options.broadcast_rows + 1)
    rows, total = head.agg(F.count(F.lit(1)), F.sum("n")).first()
    return rows <= options.broadcast_rows and (total or 0) <= options.broadcast_bytes


def only_repos(rows: DataFrame, batch: DataFrame, options: SearchOptions) -> DataFrame:
    """Push the repositories of a batch into the scan of ``rows``, when they are few enough to list.

    As a literal filter they prune partitions and row groups; with more
    repositories than ``listed_repos`` the joins alone select.
    """
    found = batch.select("repo_id").distinct().limit(options.listed_repos + 1).collect()
    if len(found) > options.listed_repos:
        return rows
    return rows.where(F.col("repo_id").isin([row.repo_id for row in found]))


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Give a scan with fewer splits than cores enough partitions for text work.

    Only a scan of fewer than ``SPREAD_SPLITS`` splits is shuffled, whatever the
    cluster's size, so what moves stays under that many ``maxPartitionBytes``.
    """
    wanted = min(2 * df.sparkSession.sparkContext.defaultParallelism, SPREAD_SPLITS)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *columns)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"{application}-")


def _path_and_system(session: SparkSession, path: str):
    target = session._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(session._jsc.hadoopConfiguration())


@cache
def _tables_folder(shared: str, application: str, session: SparkSession) -> str:
    """The application's own folder in the shared one; the file system deletes it when the application ends."""
    folder = f"{shared.rstrip('/')}/tables-{application}-{uuid.uuid4().hex[:8]}"
    target, system = _path_and_system(session, folder)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return folder


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(session: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the tables that ``durable`` stored inside it."""
    stored: list[str] = []
    token = _scratch.set(stored)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in stored:
            target, system = _path_and_system(session, path)
            system.delete(target, True)


def new_folder(session: SparkSession) -> str:
    """A folder of one's own in the cluster's shared checkpoint folder; it goes with the application or the ``scratch`` block.

    Only a local session without the setting gets a folder outside.
    """
    context = session.sparkContext
    shared = session.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local_folder(context.applicationId)
    path = f"{_tables_folder(shared, context.applicationId, session)}/{uuid.uuid4().hex}"
    stored = _scratch.get()
    if stored is not None:
        stored.append(path)
    return path


@contextmanager
def freed(session: SparkSession) -> Iterator[None]:
    """The shuffle files of a write in the block go when it ends, not when the driver happens to collect its garbage."""
    before = session.conf.get(_CLEANUP, "false")
    session.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        session.conf.set(_CLEANUP, before)


def durable(df: DataFrame) -> DataFrame:
    """Store ``df`` once in the cluster's shared checkpoint folder and read it back.

    The lineage ends at the stored table, so a lost executor costs a re-read, and
    every later use sees the same rows.  Tables live until the application ends, or the
    surrounding ``scratch`` block.
    """
    path = new_folder(df.sparkSession)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
