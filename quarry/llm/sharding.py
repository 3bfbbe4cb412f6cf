"""Sharding by sampled splitters.

Records are ordered by the hash of their text, so that equal texts lie together; a text with so many
copies that they would fill a range is dealt over many places of that order. A sample of places, drawn
in proportion to size, gives the quantile boundaries of ranges, many to a shard. Records are partitioned
by these ranges, ranges that turn out overfull are subdivided evenly, and each shard takes a run of
whole ranges that holds an equal part of all bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import free_names, if_small, stored, table, text_or_empty

#: A text whose copies hold over this part of a shard is dealt row by row.
COPIES = 64
#: Ranges of a shard at least, records of a range on average at most, draws for a range, and times the mean from which a range is overfull.
RANGES_A_SHARD, ROWS_A_RANGE, DRAWS, OVERFULL = 256, 500_000, 24, 2


def splitters(units: DataFrame, total: int, ranges: int) -> DataFrame:
    """place: at most ``ranges`` - 1 quantile boundaries of ``units`` (place, bytes), by a sample drawn in proportion to bytes."""
    sample = ranges * DRAWS
    # Systematic draws: a unit gets sample * bytes / total draws, the fraction decided by its own hash.
    chance = F.pmod(F.xxhash64("place", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = stored(units.select("place", F.floor(F.col("bytes") * sample / total + chance).alias("draws")).where("draws > 0"))
    upto = F.sum("draws").over(W.orderBy("place"))  # over the sample, about DRAWS rows for a range
    facts = drawn.agg(F.sum("draws").alias("all"))
    quantile = lambda c: F.floor(c * ranges / F.col("all"))
    at = drawn.withColumn("upto", upto).crossJoin(F.broadcast(facts))  # one row
    return at.where((quantile(F.col("upto")) > quantile(F.col("upto") - F.col("draws"))) & (quantile(F.col("upto")) < ranges)).select("place")


def cells(bounds: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """For each cell of 2 ** bits even ones of all places: the boundaries below it and those in it."""
    bits = max(2, (4 * ranges - 1).bit_length())
    cell = F.shiftright("place", 64 - bits)
    held = bounds.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list("place")).alias("inside"))
    every = bounds.sparkSession.range(-(1 << bits - 1), 1 << bits - 1).select(F.col("id").alias("cell")).join(F.broadcast(held), "cell", "left")
    inside = F.coalesce("inside", F.array().cast("array<long>"))
    below = F.coalesce(F.sum(F.size("inside")).over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each cell
    return stored(every.withColumn("inside", inside).select("cell", below.cast("int").alias("below"), "inside")), bits


def shard_documents(docs: DataFrame, shards: int = 40, ranges: int | None = None) -> DataFrame:
    """Puts every row of ``docs`` (doc_id, text; other columns are ignored) into shards of near equal bytes.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard). Size is the bytes of
    the text plus 16; a null text is empty. Equal texts share a shard, unless their copies hold over
    1/``COPIES`` of a shard's bytes or rows, or more rows than a range should; these are dealt row by row. Repeated rows are placed one by one;
    null doc_id is an ordinary key. ``ranges``: the number of ranges, which grows with the rows where
    it isn't given. An empty table gives no rows.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
            F.crc32(text_or_empty()).alias("text_crc32"),
            F.xxhash64(text_or_empty()).alias("key"),
            F.monotonically_increasing_id().alias("row"),  # written, so it stays as it is
        )
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total, count = max(total, 1), max(count, 1)
    ranges = ranges or max(shards * RANGES_A_SHARD, -(-count // ROWS_A_RANGE))
    # At most 2 * most groups can hold over 1 / most of the bytes or rows.
    most = max(shards * COPIES, -(-count // ROWS_A_RANGE))
    parts = F.ceil(F.greatest(F.col("bytes") * most / total, F.col("n") * most / count)).cast("int")
    large = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", parts.alias("parts")).where("parts > 1")
    large = stored(large)
    dealt = F.xxhash64("key", F.pmod(F.xxhash64("row"), "parts"))
    placed = rows.join(if_small(large, large.count()), "key", "left").withColumn("place", F.when(F.col("parts") > 1, dealt).otherwise(F.col("key"))).drop("key", "parts")

    bounds = stored(splitters(placed.groupBy("place").agg(F.sum("size").alias("bytes")), total, ranges))
    table_, bits = cells(bounds, ranges)
    ranged = placed.withColumn("cell", F.shiftright("place", 64 - bits)).join(if_small(table_, 1 << bits), "cell")
    ranged = stored(ranged.withColumn("range", F.col("below") + F.size(F.filter("inside", lambda b: b <= F.col("place")))).drop("cell", "below", "inside"))

    # An overfull range is cut into even pieces of its places.
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("place").cast("double").alias("least"), F.max("place").cast("double").alias("most"))
    pieces = F.ceil(F.col("bytes") * ranges / total).cast("int")
    over = sums.where(F.col("bytes") * ranges > OVERFULL * total).where("most > least").select("range", "least", (F.col("most") - F.col("least")).alias("width"), pieces.alias("pieces"))
    piece = F.least(F.floor((F.col("place").cast("double") - F.col("least")) / F.col("width") * F.col("pieces")), F.col("pieces") - 1)
    cut = ranged.join(F.broadcast(over), "range", "left").withColumn("piece", F.coalesce(piece, F.lit(0)).cast("int")).drop("least", "width", "pieces")  # half the ranges at most

    runs = cut.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = W.orderBy("range", "piece").rowsBetween(W.unboundedPreceding, -1)  # over a row for each range or piece of one
    middle = F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("bytes") / 2
    starts = runs.select("range", "piece", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int").alias("shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = stored(starts)
    firsts = starts.groupBy("shard").agg(F.min("first").alias("shard_first"))  # one row for each shard
    starts = starts.join(F.broadcast(firsts), "shard").select("range", "piece", "shard", (F.col("first") - F.col("shard_first")).alias("slot0"))

    order = W.partitionBy("range", "piece").orderBy("place", "doc_id", "row")
    numbered = cut.withColumn("nth", F.row_number().over(order) - 1)
    slot = (F.col("slot0") + F.col("nth")).cast("long")
    return numbered.join(if_small(starts, 3 * ranges), ["range", "piece"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, files_per_shard: int = 1) -> None:
    """``docs``, whose doc_id are unique, written below ``path`` in a folder for each shard, in slot order; all columns as they are."""
    shard, slot, key = free_names(docs.columns, "shard", "slot", "key")
    at = shard_documents(docs, shards).select(F.col("doc_id").alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = docs.join(at, F.col("doc_id").cast("long").eqNullSafe(F.col(key))).drop(key)
    piece = F.col(slot) % files_per_shard
    placed.repartition(shard, piece).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, by the law of near equal bytes."""
    placed = shard_documents(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
