"""Registered queries: a function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under ``name``."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def sql_query(name: str, spark_sql: str, tables: list[str], oracle: str | None = None) -> None:
    """Registers SQL text; ``oracle`` where the other engine spells it otherwise."""

    def run(t: Tables) -> DataFrame:
        return t.spark.sql(spark_sql, **{name: getattr(t, name) for name in tables})

    query(name, oracle or spark_sql.replace("{", "").replace("}", ""))(run)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
