"""Writers: tables by partition, nested documents, packed codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """One bulk write; rows of a partition value are gathered first, so that it gets few files."""
    out = df.repartition(*partition_by) if partition_by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def nested_details(master: DataFrame, details: DataFrame, key: str, into: str, order: str) -> DataFrame:
    """Master rows with an ordered array of their detail rows, ready for a JSON or XML writer."""
    fields = [c for c in details.columns if c != key]
    lists = details.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(into))
    return master.join(lists, key, "left")


def save_xml(df: DataFrame, path: str, row_tag: str = "row") -> None:
    df.write.option("rowTag", row_tag).format("xml").save(path)


def pack_codes(codes: Column) -> Column:
    """array<int> as big-endian unsigned 32-bit values in binary."""
    return F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")), ""))


def unpack_codes(packed: Column) -> Column:
    """Binary of big-endian unsigned 32-bit values as array<bigint>; each is cut from the bytes where it lies."""
    count = (F.octet_length(packed) / 4).cast("int")
    code = lambda i: F.conv(F.hex(F.substring(packed, (i - 1) * 4 + 1, F.lit(4))), 16, 10).cast("long")
    return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), code))


def packed_records(df: DataFrame, part: Column, code: str, most: int = 65_536) -> DataFrame:
    """part and packed: the codes of each part in records of at most ``most`` codes, so no row grows with the table."""
    numbered = df.select(part.alias("part"), code, F.floor(F.monotonically_increasing_id() / most).alias("_record"))
    return numbered.groupBy("part", "_record").agg(pack_codes(F.collect_list(code)).alias("packed")).drop("_record")
