"""Shared scratch space: tables that cut lineage and files that executors hand to each other.

Everything lands under ``spark.checkpoint.dir`` as the session has it, the one folder that the
driver and all executors are known to share. Only where that is unset and Spark runs in local mode a private
folder stands in, removed when the driver exits; on a cluster that would lose files silently, so root() raises.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_local = threading.local()


def root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: a lost executor then costs no recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if own := _scopes():
        own[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut inside go at the end; only what keep() wrote stays. Lazy results of them must not leave."""
    _scopes().append([])
    try:
        yield
    finally:
        drop(spark, *_scopes().pop())


def keep(df: DataFrame, name: str) -> DataFrame:
    """As cut(), for a table that outlives the innermost scratch()."""
    inner = _scopes().pop() if _scopes() else None
    try:
        return cut(df, name)[0]
    finally:
        if inner is not None:
            _scopes().append(inner)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables or files of cut() and new_path() that nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does once the driver's JVM has collected what referred to them.

    Twice, as listeners hold on to a job that has only just ended.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session send at most ``rows`` rows at once to Python: texts are long, and JVM and worker both hold a batch or more.

    A smaller setting of the session stays. It changes no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Let a Python worker that earlier stages used return the memory that it holds but doesn't use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
