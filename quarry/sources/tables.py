"""Readers of tables and files; every reader takes an explicit schema or derives one from the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.relational import running_total

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for SQL text."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text by an explicit schema; bad fields are null."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode="PERMISSIVE")


def decimal_comma(c: Column) -> Column:
    """A number written with a decimal comma; null if it isn't one."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def read_transactions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """One basket to a line: items array<string>, trimmed and without empty ones."""
    items = F.filter(F.transform(F.split("value", sep), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path).select(items.alias("items"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A word and its components, white space between: word, vector array<double>."""
    parts = F.split(F.trim("value"), r"\s+")
    vector = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.try_cast("double"))
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("word"), vector.alias("vector"))


def name_and_number(line: Column) -> tuple[Column, Column]:
    """``name ... 42`` -> name and trailing whole number (null if it's missing or too large)."""
    name = F.trim(F.regexp_replace(line, r"\s*-?\d+\s*$", ""))
    return name, F.nullif(F.regexp_extract(line, r"(-?\d+)\s*$", 1), F.lit("")).try_cast("int")


def read_sections(lines: DataFrame, order: str = "line") -> DataFrame:
    """``[section]`` headings and ``key=value`` lines -> section, key, value; ``lines``: line number and value.

    A section's number is the running count of headings, over one file's lines.
    """
    heading = F.regexp_extract("value", r"^\s*\[(.*)\]\s*$", 1)
    numbered = running_total(lines, [order], F.when(heading != "", 1).otherwise(0).cast("long"), "section_no")
    headings = numbered.where(heading != "").select("section_no", heading.alias("section"))
    named = numbered.join(headings, "section_no", "left")
    pair = named.where(F.col("value").contains("=") & (heading == ""))
    return pair.select("section_no", "section", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.expr("substring(value, instr(value, '=') + 1)")).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: one row for each line of the files below ``path``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file and text: one row for each file below ``path``, which has to fit a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_xml(spark: SparkSession, path: str, schema: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def documents_from_json(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Texts that are JSON arrays of documents, as many rows; a single document counts as an array of one, other text gives none."""
    return lines.select(F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("d")).select("d.*")


def html_text(html: Column) -> Column:
    """Visible text of HTML: scripts, styles, comments and tags go, common entities are undone, white space folds."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def relative_row(df: DataFrame, order: list, position: int) -> DataFrame:
    """A scrollable cursor's row: counted from 1, or from the end if negative."""
    keys = [F.desc(c) if position < 0 else F.asc(c) for c in order]
    return df.orderBy(*keys).offset(abs(position) - 1).limit(1)


def cursor_walk(df: DataFrame, order: list[str], moves: list[tuple[str, int]]) -> DataFrame:
    """The rows a scrollable cursor reads: step (from 1) and the row's columns; a move beyond the ends reads none.

    A move: first, last, next, prior, absolute (from 1, or from the end if negative) or relative, and its number.
    """
    total, at, places = df.count(), 0, []
    for how, n in moves:
        at = {"first": 1, "last": total, "next": at + 1, "prior": at - 1, "absolute": n if n >= 0 else total + 1 + n, "relative": at + n}[how]
        at = max(0, min(at, total + 1))
        places.append(at)
    numbered = running_total(df, order, F.lit(1).cast("long"), "_n")
    wanted = df.sparkSession.createDataFrame([(k, p) for k, p in enumerate(places, 1)], "step int, _n long")
    return numbered.join(F.broadcast(wanted), "_n").drop("_n")  # a row for each move


def catalog_of(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    """table_name, position (from 1) and column_name of tables and views that the session's catalog knows."""
    rows = [(n, k, c.name) for n in names if spark.catalog.tableExists(n) for k, c in enumerate(spark.catalog.listColumns(n), 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string")


def catalog_columns(df: DataFrame, table: str) -> DataFrame:
    """Introspection: table, position, column, type of each column."""
    rows = [(table, k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
