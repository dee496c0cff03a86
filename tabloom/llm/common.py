"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words and what is stripped from lines.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_kept: list[list[str]] = []
_named: dict[str, str] = {}
#: Functions that drop what a Python worker keeps from task to task, such as the tables of tokenizers.
given_back: list[Callable[[], None]] = []
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The share of the driver's heap that may fill before ``tidied`` has its garbage collected, and what was left last time.
_FILLED = 1 / 6
_left: dict[str, int] = {}
#: Seconds between two looks at the driver's heap while a table is written, and the threads that look.
_EVERY = 2.0
_writing: list[str] = []
_watching: dict[str, threading.Thread] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; where it is unset, a folder of our own, on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tabloom-")
    return "file://" + _own[app]


def saved(df: DataFrame, name: str, keep: bool = False, key: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage durably.

    Within ``scratch`` the table is removed at its end, but for those to ``keep``.  With a ``key`` it is bucketed by that
    column into ``spark.sql.shuffle.partitions`` buckets, so that joins on the key alone need not shuffle it again; such
    a table has an entry in the session's catalog until it is removed.

    While it writes, Arrow batches hold at most 1000 rows: rows hold whole texts, and a batch is held several times.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(was), 1000)) if int(was) > 0 else "1000")
    _watched(spark)
    _writing.append(path)
    try:
        if key:
            _named[path] = f"tabloom_{name}_{uuid.uuid4().hex}".replace("-", "_")
            df.write.format("parquet").bucketBy(buckets(spark), key).option("path", path).saveAsTable(_named[path])
        else:
            df.write.parquet(path)
    finally:
        _writing.remove(path)
        spark.conf.set(_BATCH, was)
        if _kept and not keep:
            _kept[-1].append(path)
        tidied(spark)
    return spark.table(_named[path]) if key else spark.read.schema(df.schema).parquet(path)


def tidied(spark: SparkSession) -> None:
    """Collect the driver's garbage once it has filled a sixth of the heap.

    Called at the end of a step and every few seconds within one.  Shuffles and broadcasts of steps that are over stay, in the driver and on disk, until the driver's garbage is
    collected, and a job of many steps and tasks lets the driver's heap grow to its limit before that happens.
    """
    runtime, app = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext.applicationId
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    if used() - _left.get(app, 0) >= runtime.maxMemory() * _FILLED:
        gc.collect()  # of what Python still names, the JVM frees nothing
        spark._jvm.java.lang.System.gc()
        _left[app] = used()


def _watched(spark: SparkSession) -> None:
    """Have one thread look after the driver's heap while tables are written: with larger input, garbage comes within steps."""
    app = spark.sparkContext.applicationId

    def look() -> None:
        while spark.sparkContext._jsc is not None:
            time.sleep(_EVERY)
            try:
                if _writing:
                    tidied(spark)
            except Exception:  # the session has ended
                return

    if app not in _watching or not _watching[app].is_alive():
        _watching[app] = threading.Thread(target=look, daemon=True, name="tabloom-heap")
        _watching[app].start()


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in _named:
            spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``saved`` within are removed at the end, so that one run holds no disk for the next."""
    _kept.append([])
    try:
        yield
    finally:
        removed(spark, _kept.pop())


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take Spark's quicker ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def packed(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """``df`` in at most as many partitions as ``rows`` rows of it need, so that small tables take few tasks."""
    return df.coalesce(max(1, -(-rows // each)))


@cache
def _trim() -> Callable[[int], int] | None:
    """``malloc_trim``, where the C library has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """``run`` for ``mapInArrow``, in a worker that holds no more memory than it uses.

    Spark's workers go on from task to task and from operator to operator, and allocators keep what was freed: so each
    task hands freed memory back to the system, and first of all what other operators left, unless it ``keeps`` that.
    """

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            for drop in given_back:
                drop()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return leaner
