"""Shared helpers of the training-data operators: tables, the shared folder, words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch sent to a Python worker, so that one batch of very long texts stays small.
BATCH_BYTES, BATCH_ROWS = "4m", 4096
#: Bytes of rows up to which a side of a join is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 8 << 20
#: Spark's setting that a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master without that setting (as in tests) falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.gettempdir(), "quarry-shared").as_uri()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, path: str | None = None, codec: str = "none") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there.

    Its shuffles' files, which nothing reads again, are deleted once it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain_names(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1 and so on: names with dots or backticks can't go through ``mapInArrow``."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows of fixed-width columns and fingerprints, to be broadcast if it is surely below ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * (16 + 32 * len(df.columns)) <= BROADCAST_BYTES else df


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, not only by rows.

    The bounds are settings of the session, read when the plan runs, so they stay set; a session's own
    smaller number of rows is kept.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(partial(_trimmed, f), schema)


def _trimmed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ``f``, then hands freed memory back to the system: workers are kept from task to task."""
    yield from f(batches)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_names(names: list[str], *wanted: str) -> list[str]:
    """Each of ``wanted`` with underscores before it until it is no name of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


class WordIds(dict):
    """64-bit hashes of words (bytes), kept up to ``limit`` distinct words."""

    def __init__(self, limit: int = 250_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
