"""Session builder used by the benchmark, the tests and the examples."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow on; ``extra`` overrides any key."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """A path below ``spark.checkpoint.dir`` that doesn't exist yet; a local master without that setting gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = Path(tempfile.gettempdir(), "quarry-shared").as_uri()
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once: written as a table to the shared folder and read again, which also prunes columns."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
