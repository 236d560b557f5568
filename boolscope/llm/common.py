"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import pairwise
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a trim set and as regular expressions.
SPACE = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named, a temporary one in local mode;
    on a cluster that is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders of the tables that save() returned.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Folders written by save() within scratch(), per nested use.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are saved inside are deleted at the end, but those that the given function was called with."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(saved_path(df))
        if outer := _SCRATCH.get()[:-1]:
            outer[-1].append(saved_path(df))
        return df

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for p in paths:
            remove(spark, p)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside passes at most so many rows at a time between the JVM and Python: whole texts then take a few MB in
    either, and the JVM keeps less memory of its own for them. The setting is restored."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to a new Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    if _SCRATCH.get():
        _SCRATCH.get()[-1].append(path)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that it works on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved_path(df: DataFrame) -> str:
    """The folder of a table written by save()."""
    return _PATHS[df]


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the column's text, modulo n: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string")) % n


def slices(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows that follow each other and have about so many bytes in the column together, one row at least."""
    sizes = np.fromiter((len(t.as_buffer()) if t.is_valid else 0 for t in batch[column]), np.int64, batch.num_rows)
    part = np.cumsum(sizes) // size
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(at):
        if b > a:
            yield batch.slice(a, b - a)


#: Dictionaries that worker processes keep from task to task, by name.
CACHES: dict[str, dict] = {}


def give_back() -> None:
    """Give freed memory back to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def release(but: str | None) -> None:
    others = [kept for name, kept in CACHES.items() if name != but and kept]
    for kept in others:
        kept.clear()
    if others:
        give_back()


def trimmed(run: Callable[[Iterator], Iterator], cache: str | None = None) -> Callable[[Iterator], Iterator]:
    """A function over batches that, when done, gives freed memory back to the system: worker processes outlive tasks.
    What other functions keep in them, but for the named cache, goes first."""

    def wrapped(batches: Iterator) -> Iterator:
        release(cache)
        yield from run(batches)
        give_back()

    return wrapped
