"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What `[\x20\x09-\x0D]` matches.
SPACE = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path that is no longer read, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder, so that it is computed once and outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def described(spark: SparkSession, text: str) -> Iterator[None]:
    """Names what jobs do and read, in the UI and the event log: jobs on RDDs have no plan that does."""
    own = spark.sparkContext
    before = own.getLocalProperty("spark.job.description")
    own.setJobDescription(text)
    try:
        yield
    finally:
        own.setLocalProperty("spark.job.description", before)


#: Arrow batches of about 4 MB, so that long texts don't fill the memory of task and worker.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: Shuffle files go when the job that made them ends; for jobs whose results are written.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for the jobs that run within."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column `text` holds about `most` bytes, or one row if that is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `most` bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = _SPACES.search(text, min(at + most, len(text)))
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to + 1


class Memo(dict):
    """A bounded cache of a pure function. When full, what wasn't used since it last was full is forgotten; results never depend on that.

    Keys longer than LONGEST are worked out anew each time, so that few long ones don't fill the memory."""

    LONGEST = 64

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
