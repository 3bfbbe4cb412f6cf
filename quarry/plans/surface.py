"""Queries of the function surface: SQL functions, catalog, parsed lines, rules, outranking kernels, sliding frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import mining as M
from quarry.plans.registry import Tables, query, rounded
from quarry.session import cut_lineage
from quarry.sources import tables as S
from quarry.streaming import windows as ST


@query("sql_function_default", "SELECT c_custkey, round(c_acctbal * 0.8, 4) AS net, round(c_acctbal * 0.5, 4) AS half FROM customer")
def sql_function_default(t: Tables):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_amount(amount DOUBLE, rate DOUBLE DEFAULT 0.2) RETURNS DOUBLE RETURN amount * (1 - rate)")
    return t.spark.sql("SELECT c_custkey, round(net_amount(c_acctbal), 4) AS net, round(net_amount(c_acctbal, 0.5), 4) AS half FROM {c}", c=t.customer)


@query("session_variable", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def session_variable(t: Tables):
    t.spark.sql("DECLARE OR REPLACE VARIABLE price_limit DOUBLE DEFAULT 0.0")
    t.spark.sql("SET VAR price_limit = 100000.0")
    return t.spark.sql("SELECT count(*) AS n FROM {o} WHERE o_totalprice > price_limit", o=t.orders)


@query("row_struct_function", "SELECT n_nationkey, count(c_custkey) AS n, round(max(c_acctbal), 4) AS top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def row_struct_function(t: Tables):
    facts = t.customer.groupBy("c_nationkey").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("top")).alias("out"))
    rows = t.nation.join(facts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select("n_nationkey", F.coalesce("out.n", F.lit(0)).cast("long").alias("n"), rounded(F.col("out.top"), 4).alias("top"))


@query("catalog_columns", "SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name, CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(replace(data_type, 'TIMESTAMP', 'timestamp_ntz')) END AS data_type FROM information_schema.columns WHERE table_name IN ('customer', 'lineitem')")
def catalog_columns(t: Tables):
    return S.catalog_columns(t.customer, "customer").union(S.catalog_columns(t.lineitem, "lineitem"))


@query("name_and_number", "SELECT p_partkey, p_brand AS name, p_size AS number FROM part")
def name_and_number(t: Tables):
    line = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    name, number = S.name_and_number(line)
    return t.part.select("p_partkey", name.alias("name"), number.alias("number"))


@query("sectioned_import", "SELECT r_name AS section, sum(n_nationkey)::BIGINT AS keys, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sectioned_import(t: Tables):
    heads = t.region.select((F.col("r_regionkey") * 1000).alias("line"), F.concat(F.lit("["), "r_name", F.lit("]")).alias("value"))
    pairs = t.nation.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("line"), F.concat("n_name", F.lit(" = "), F.col("n_nationkey").cast("string")).alias("value"))
    rows = S.read_sections(heads.unionByName(pairs))
    return rows.groupBy("section").agg(F.sum(F.col("value").cast("long")).alias("keys"), F.count(F.lit(1)).alias("n"))


@query("json_dispatch", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_dispatch(t: Tables):
    rows = t.events.select("event_type", F.from_json("props", "k bigint, room struct<name: string>").alias("d"))
    return rows.where("d.k is not null or d.room is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("d.k").alias("total"))


@query("sliding_frames", "SELECT CAST(w AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT e.event_type, e.value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events e) GROUP BY 1, 2")
def sliding_frames(t: Tables):
    w = ST.windowed_counts(t.events, "2 hours", "1 hour")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", rounded(F.col("total"), 2).alias("total"))


def kernel(outranks: DataFrame, names: DataFrame) -> DataFrame:
    """The kernel of an acyclic outranking graph: what nothing in it outranks, and each other outranked by one of it.

    ``outranks``: a, b; ``names``: name. Each turn settles one layer, until no free one is left: those that
    remain then lie on a cycle or are outranked from one, and are in no kernel.
    """
    left, kept = names.select("name"), names.select("name").limit(0)
    while True:
        edges = outranks.join(left.select(F.col("name").alias("a")), "a").join(left.select(F.col("name").alias("b")), "b")
        free = cut_lineage(left.join(edges.select(F.col("b").alias("name")).distinct(), "name", "left_anti"))
        if free.isEmpty():
            return kept
        kept = kept.union(free)
        beaten = outranks.join(free.select(F.col("name").alias("a")), "a").select(F.col("b").alias("name")).distinct()
        left = cut_lineage(left.join(free, "name", "left_anti").join(beaten, "name", "left_anti"))


@query("outranking_kernel")
def outranking_kernel(t: Tables):
    criteria = {"n": {"gain": True, "weight": 2.0, "q": 0, "p": 30, "v": 2000}, "m": {"gain": False, "weight": 1.0, "q": 0.0, "p": 800.0, "v": 30000.0}}
    alternatives = t.customer.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"))
    edges = cut_lineage(M.outranking(alternatives, criteria, 0.7).where("outranks").select("a", "b"))
    strict = edges.join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return kernel(strict, alternatives)


@query("majority_baseline", "SELECT quality AS label, round(count(*) / (SELECT count(*) FROM labels), 6) AS accuracy FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def majority_baseline(t: Tables):
    counts = t.labels.groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = t.labels.agg(F.count(F.lit(1)).alias("all_rows"))
    return counts.orderBy(F.desc("n"), "label").limit(1).crossJoin(F.broadcast(total)).select("label", rounded(F.col("n") / F.col("all_rows")).alias("accuracy"))  # one row each


@query("undersampled", "SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':1'), doc_id) AS k FROM labels) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))")
def undersampled(t: Tables):
    return M.undersampled(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


@query("oversampled", "WITH s AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT doc_id, toxic, n, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS k FROM labels JOIN s USING (toxic)) SELECT doc_id, toxic, CAST(unnest(range(0, 1 + ((SELECT max(n) FROM s) - k) // n)) AS BIGINT) AS copy FROM r")
def oversampled(t: Tables):
    return M.oversampled(t.labels.select("doc_id", "toxic"), "toxic", "doc_id")


@query("low_variance_features", "SELECT feature FROM (SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice) FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', var_samp(l_tax) FROM lineitem) WHERE v < 0.01")
def low_variance_features(t: Tables):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    one = t.lineitem.agg(*[F.var_samp(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in columns])).alias("f")).where("f.v < 0.01").select("f.feature")


@query("full_joint_bayes", "SELECT c_mktsegment AS label, CAST(c_acctbal > 0 AS INTEGER) AS a, CAST(c_nationkey < 10 AS INTEGER) AS b, round((count(*) + 1) / (sum(count(*)) OVER (PARTITION BY c_mktsegment) + 4), 6) AS p FROM customer GROUP BY 1, 2, 3")
def full_joint_bayes(t: Tables):
    cells = t.customer.groupBy(F.col("c_mktsegment").alias("label"), (F.col("c_acctbal") > 0).cast("int").alias("a"), (F.col("c_nationkey") < 10).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("label").agg(F.sum("n").alias("total"))
    return cells.join(totals, "label").select("label", "a", "b", rounded((F.col("n") + 1) / (F.col("total") + 4)).alias("p"))
