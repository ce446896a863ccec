"""Session set-up and durable intermediate storage."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerproof")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    """One folder for this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder.

    A lost executor re-reads files. The table is columnar, so each reader takes only
    the columns it needs, and the input is computed once.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh output path in this application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Removes this application's stored stages; results that still read them can't run then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_stored: ContextVar[dict | None] = ContextVar("stored", default=None)


@contextlib.contextmanager
def one_job() -> Iterator[None]:
    """Within it each `stored_once` table is made and written once, however many parts read it."""
    token = _stored.set({})
    try:
        yield
    finally:
        _stored.reset(token)


def known_once(build: Callable) -> Callable:
    """A small value of (spark, root), worked out once inside a job."""

    @functools.wraps(build)
    def made(spark: SparkSession, *args):
        memo = _stored.get()
        if memo is None:
            return build(spark, *args)
        key = (build.__module__, build.__qualname__, args)
        if key not in memo:
            memo[key] = build(spark, *args)
        return memo[key]

    return made


def stored_once(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A builder (spark, root, ...) whose table is a stored stage inside a job, and lazy outside."""

    @functools.wraps(build)
    def stored(spark: SparkSession, *args) -> DataFrame:
        return durable(build(spark, *args))

    once = known_once(stored)

    @functools.wraps(build)
    def made(spark: SparkSession, *args) -> DataFrame:
        return build(spark, *args) if _stored.get() is None else once(spark, *args)

    return made


def unstored(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The lazy form of a `stored_once` builder, for a job that reads its table once."""
    return build.__wrapped__
