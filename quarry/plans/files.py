"""Queries that write tables in a file format and read them back: delimited text, lines, JSON, XML, saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query, rounded
from quarry.session import shared_folder
from quarry.sources import sinks
from quarry.sources import tables as S


def written_text(df: DataFrame, value) -> str:
    """A folder with a line of text for each row."""
    path = shared_folder(df.sparkSession)
    df.select(value.alias("value")).write.text(path)
    return path


@query("csv_header", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_header(t: Tables):
    path = shared_folder(t.spark)
    t.nation.select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    return S.read_delimited(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("tsv_columns", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def tsv_columns(t: Tables):
    path = shared_folder(t.spark)
    t.supplier.select("s_suppkey", "s_name", "s_nationkey").write.csv(path, sep="\t", header=True)
    return S.read_delimited(t.spark, path, "s_suppkey long, s_name string, s_nationkey int", sep="\t")


@query("csv_without_header", "SELECT p_partkey AS a, p_size AS b, p_retailprice AS c FROM part")
def csv_without_header(t: Tables):
    path = shared_folder(t.spark)
    t.part.select("p_partkey", "p_size", "p_retailprice").write.csv(path)
    return S.read_delimited(t.spark, path, "a long, b int, c double", header=False)


@query("csv_overridden_types", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def csv_overridden_types(t: Tables):
    path = shared_folder(t.spark)
    t.part.select("p_partkey", "p_size").write.csv(path, header=True)
    return S.read_delimited(t.spark, path, "p_partkey string, p_size double")


@query("csv_decimal_comma", "SELECT c_custkey, round(c_acctbal, 4) AS balance FROM customer")
def csv_decimal_comma(t: Tables):
    path = shared_folder(t.spark)
    shown = F.translate(F.col("c_acctbal").cast("string"), ".", ",")
    t.customer.select("c_custkey", shown.alias("balance")).write.csv(path, sep=";", header=True)
    rows = S.read_delimited(t.spark, path, "c_custkey long, balance string", sep=";")
    return rows.select("c_custkey", rounded(S.decimal_comma(F.col("balance")), 4).alias("balance"))


@query("text_lines", "SELECT n_name AS line, length(n_name) AS chars FROM nation")
def text_lines(t: Tables):
    return S.read_lines(t.spark, written_text(t.nation, F.col("n_name"))).select("line", F.length("line").cast("long").alias("chars"))


@query("text_whole_files", "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT n_regionkey, sum(length(n_name) + 1) AS n FROM nation GROUP BY 1)")
def text_whole_files(t: Tables):
    path = shared_folder(t.spark)
    t.nation.select("n_regionkey", "n_name").repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return S.read_whole_files(t.spark, path).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("transactions_file", "SELECT item, count(*) AS n FROM (SELECT DISTINCT l_orderkey, 'p' || l_linenumber AS item FROM lineitem) GROUP BY 1")
def transactions_file(t: Tables):
    baskets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), "l_linenumber")).alias("items"))
    path = written_text(baskets, F.array_join("items", ", "))
    return S.read_transactions(t.spark, path).select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("word_vectors_file", "SELECT 'w' || vec_id AS word, CAST(len(embedding) AS INTEGER) AS width, round(embedding[2]::DOUBLE, 4) AS second FROM embeddings")
def word_vectors_file(t: Tables):
    line = F.concat(F.lit("w"), "vec_id", F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " "))
    rows = S.read_word_vectors(t.spark, written_text(t.embeddings, line))
    return rows.select("word", F.size("vector").alias("width"), rounded(F.col("vector")[1], 4).alias("second"))


@query("json_insert_many", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def json_insert_many(t: Tables):
    document = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    many = t.customer.groupBy(F.col("c_nationkey")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(document), ","), F.lit("]")).alias("value"))
    return S.documents_from_json(many, "id bigint, name string, nation int")


@query("xml_details", "SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def xml_details(t: Tables):
    lines = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    nested = sinks.nested_details(lines.select("o_custkey").distinct(), lines, "o_custkey", "order", "o_orderkey")
    path = shared_folder(t.spark)
    sinks.save_xml(nested, path, "customer")
    back = S.read_xml(t.spark, path, "o_custkey bigint, order array<struct<o_orderkey: bigint, o_totalprice: double>>", "customer")
    flat = back.select("o_custkey", F.explode("order").alias("o"))
    return flat.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), rounded(F.sum("o.o_totalprice"), 2).alias("total"))


@query("table_as_select", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS m FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def table_as_select(t: Tables):
    path = shared_folder(t.spark)
    sinks.save_parquet(t.customer.where("c_acctbal > 0"), path, ["c_mktsegment"])
    saved = t.spark.read.parquet(path)
    return saved.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("c_acctbal"), 4).alias("m"))


@query("batch_insert", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys, CAST(count(DISTINCT c_custkey) AS BIGINT) AS distinct_keys FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_acctbal < 0)")
def batch_insert(t: Tables):
    path = shared_folder(t.spark)
    sinks.save_parquet(t.customer.select("c_custkey"), path)
    sinks.save_parquet(t.customer.where("c_acctbal < 0").select((F.col("c_custkey") + 1_000_000).alias("c_custkey")), path, mode="append")
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.count_distinct("c_custkey").alias("distinct_keys"))


@query("binary_codes_file", "SELECT o_orderkey % 16 AS part, count(*) AS codes, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def binary_codes_file(t: Tables):
    packed = sinks.packed_records(t.orders, F.col("o_orderkey") % 16, "o_orderkey")
    path = shared_folder(t.spark)
    sinks.save_parquet(packed, path)
    codes = F.col("unpacked")
    records = t.spark.read.parquet(path).withColumn("unpacked", sinks.unpack_codes(F.col("packed"))).select("part", F.size(codes).cast("long").alias("codes"), F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
    return records.groupBy("part").agg(F.sum("codes").alias("codes"), F.sum("total").alias("total"))


@query("catalog_views", "SELECT table_name, CAST(ordinal_position AS INTEGER) AS position, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')")
def catalog_views(t: Tables):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    S.register_views(t.spark, t.sf_dir, names)
    return S.catalog_of(t.spark, names)
