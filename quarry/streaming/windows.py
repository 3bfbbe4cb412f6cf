"""Event-time operators. Windows and rules are the same functions on batch and streaming DataFrames; pairing and
sessions by gap look at neighbouring rows, so a stream has functions of its own, which keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """``column`` as TIMESTAMP (watermarks reject TIMESTAMP_NTZ); the session's time zone is to be UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Events and value sums by window and keys; ``late``: the watermark's delay, on streams."""
    rows = events.withWatermark("ts", late) if late else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def session_counts(events: DataFrame, gap: str, key: str = "user_id", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def sessions_by_gap(events: DataFrame, seconds: int, key: str = "user_id") -> DataFrame:
    """The batch twin of ``session_counts``: a session ends where the next event is ``seconds`` or more away, to
    the microsecond. Events without a time come last, each a session of its own."""
    w = W.partitionBy(key).orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    micros = lambda ts: F.unix_micros(ts.cast("timestamp"))
    new = F.coalesce((micros(F.col("ts")) - micros(F.lag("ts").over(w)) >= seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n"))


def enter_leave_pairs(events: DataFrame, enter: str, leave: str, key: str = "user_id", kind: str = "event_type") -> DataFrame:
    """Each ``enter`` event with the next event of its key, where that is a ``leave``: key, entered, left_at."""
    w = W.partitionBy(key).orderBy("ts", "event_id")
    following = events.where(F.col(kind).isin(enter, leave)).withColumns({"_next": F.lead(kind).over(w), "left_at": F.lead("ts").over(w)})
    return following.where((F.col(kind) == enter) & (F.col("_next") == leave)).select(key, F.col("ts").alias("entered"), "left_at")


def alarms(events: DataFrame, kind: str, above: float) -> DataFrame:
    """A stateless rule: events of a kind with a value above a limit."""
    return events.where((F.col("event_type") == kind) & (F.col("value") > above))


def read_event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return with_event_time((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path))


def append_audit(stream: DataFrame, path: str, checkpoint: str):
    """An audit log kept by each micro-batch; its number makes a repeated batch overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the parquet files called ``name`` in ``folder``, with event time."""
    return with_event_time(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder))


def paired_stream(stream: DataFrame, enter: str, leave: str, key: str = "user_id", kind: str = "event_type") -> DataFrame:
    """``enter_leave_pairs`` of a stream: key, event_id of the enter event, entered, left_at.

    The state of a key is its last enter event that nothing followed; a micro-batch's events of a key are
    taken in order of time. Events of a key are to arrive in order from batch to batch.
    """

    def pairs(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        held = state.get if state.exists else None
        out = []
        for event, at, what in zip(rows["event_id"], rows["ts"], rows[kind], strict=True):
            if what == enter:
                held = (int(event), at.to_pydatetime())
            else:
                if held is not None:
                    out.append((k[0], held[0], held[1], at))
                held = None
        if held is not None:
            state.update(held)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "event_id", "entered", "left_at"])

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"{key} {kinds[key]}, event_id bigint, entered timestamp, left_at timestamp"
    wanted = stream.where(stream[kind].isin(enter, leave)).select(key, "event_id", "ts", kind)
    return wanted.groupBy(key).applyInPandasWithState(pairs, schema, "event_id bigint, entered timestamp", "append", "NoTimeout")


def kept_counts(stream: DataFrame, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts that the stream's state keeps; in update mode a micro-batch gives those that it changed."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, with the micro-batch's number as column batch, as a table at ``path``."""

    def write(part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return spark.read.schema(f"{fields}, batch int").option("basePath", path).parquet(f"{path}/batch=*")
