"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster names it in spark.checkpoint.dir; only where that is unset (tests) a temporary one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="recollect-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, for narrow tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the action that made them ends. Without, they stay until the driver drops its plans, which adds up over iterations."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Rounds:
    """The states of an iteration as tables in the shared folder. A state is written over the one before the last, so two are there at most."""

    def __init__(self, spark: SparkSession):
        self.spark, self.number = spark, 0
        self.path = f"{shared_folder(spark)}/recollect-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}-{self.number % 2}"
        self.number += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def stage_table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, for wide tables: later reads fetch only the columns they use."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recollect-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session's Arrow batches at most so many rows: texts are long, and a batch stands several times in memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) > rows:
        conf.set(key, str(rows))
    return df


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function after which the worker, which stays alive for later tasks, gives its free memory back to the system."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about max_bytes together; a longer text comes alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, done + max_bytes, "right")))
        yield batch.slice(at, end - at)
        at, done = end, int(size[end - 1])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


class UnitCache:
    """What an encoder gives for units that recur, such as words: a worker keeps it over batches and tasks.

    It holds about `limit` bytes; units over `longest` bytes are never kept.
    """

    def __init__(self, encode: Callable[[list[bytes]], Iterable[bytes]], limit: int = 32 << 20, longest: int = 64):
        self.encode, self.limit, self.longest, self.known, self.size = encode, limit, longest, {}, 0

    def of(self, units: list[bytes]) -> list:
        """The encoding of each unit."""
        return [*map(self.prepare(units).__getitem__, units)]

    def prepare(self, units: Iterable[bytes]) -> dict:
        """A table that holds every one of these units."""
        if self.size > self.limit:
            self.known, self.size = {}, 0
        distinct = set(units)
        new = [u for u in distinct if u not in self.known]
        made = [*self.encode(new)] if new else []
        kept = {u: x for u, x in zip(new, made, strict=True) if len(u) <= self.longest}
        self.known.update(kept)
        self.size += sum(250 + len(u) + (len(x) if isinstance(x, bytes) else 0) for u, x in kept.items())  # with the table's own part
        if len(kept) == len(new):
            return self.known
        return {u: self.known[u] for u in distinct if u in self.known} | dict(zip(new, made, strict=True))
