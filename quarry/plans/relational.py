"""Queries of the relational core: predicates, joins, subqueries, aggregation, ranking, sets, rows as new tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.plans.registry import Tables, query, rounded, sql_query

# --- projection and predicates -------------------------------------------------------------------
sql_query("sel_arithmetic", "SELECT o_orderkey, round(o_totalprice * 12 + 100, 2) AS yearly FROM {orders}", ["orders"])
sql_query("sel_coalesce", "SELECT c_custkey, round(c_acctbal + coalesce(nullif(c_acctbal, abs(c_acctbal)), 0), 2) AS adjusted FROM {customer}", ["customer"])
sql_query("sel_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}", ["part"])
sql_query("sel_like", "SELECT p_partkey, p_type FROM {part} WHERE p_type LIKE '%E%' AND p_name LIKE 'p%' OR p_brand LIKE '%2'", ["part"])
sql_query("sel_in_between", "SELECT p_partkey, p_size FROM {part} WHERE p_size IN (1, 5, 9, 14) OR (p_size BETWEEN 20 AND 30 AND p_retailprice NOT BETWEEN 1000 AND 1200)", ["part"])
sql_query("sel_is_null", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS no_segment FROM {customer} WHERE nullif(c_nationkey, 3) IS NOT NULL", ["customer"])
sql_query("sel_cast_decimal", "SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(10,4)) AS DOUBLE) AS price FROM {part} WHERE p_size NOT IN (1, 2)", ["part"])
sql_query("sel_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS state, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'middle' ELSE 'high' END AS band FROM {orders}", ["orders"])
sql_query(
    "sel_decode_sign",
    "SELECT c_custkey, decode(sign(c_acctbal - 5000), -1, 'below', 0, 'at', 'above') AS side FROM {customer}",
    ["customer"],
    "SELECT c_custkey, CASE sign(c_acctbal - 5000) WHEN -1 THEN 'below' WHEN 0 THEN 'at' ELSE 'above' END AS side FROM customer",
)
sql_query(
    "sel_strings",
    "SELECT c_custkey, upper(substring(c_name, 1, 4)) || lpad(cast(c_nationkey AS string), 3, '0') AS code, translate(c_mktsegment, 'AEIOU', 'aeiou') AS segment, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS dashed, initcap(lower(c_mktsegment)) AS title FROM {customer}",
    ["customer"],
    "SELECT c_custkey, upper(substring(c_name, 1, 4)) || lpad(cast(c_nationkey AS varchar), 3, '0') AS code, translate(c_mktsegment, 'AEIOU', 'aeiou') AS segment, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, '#', '-') AS dashed, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title FROM customer",
)
sql_query(
    "sel_dates",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(floor(datediff(date'2000-01-01', CAST(o_orderdate AS DATE)) / 365) AS BIGINT) AS whole_years, CAST(add_months(CAST(o_orderdate AS DATE), 2) AS STRING) AS later, CAST(weekday(o_orderdate) AS BIGINT) AS wd, date_format(o_orderdate, 'yyyy/MM') AS ym FROM {orders}",
    ["orders"],
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') / 365) AS BIGINT) AS whole_years, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS later, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS wd, strftime(o_orderdate, '%Y/%m') AS ym FROM orders",
)
sql_query("sel_math", "SELECT p_partkey, round(power(1 + p_size / 100.0D, 3), 6) AS grown, floor(p_retailprice / 7) AS f, abs(p_size - 25) AS d, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS s FROM {part}", ["part"],
          "SELECT p_partkey, round(power(1 + p_size / 100.0::DOUBLE, 3), 6) AS grown, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, abs(p_size - 25) AS d, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS s FROM part")
sql_query("sel_hashes", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM {customer}", ["customer"], "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")


@query("sel_parameters", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) = DATE '2024-01-15' AND value > 10")
def sel_parameters(t: Tables):
    return t.spark.sql("SELECT event_id, user_id, value FROM {events} WHERE event_type = :kind AND to_date(ts) = :day AND value > :least", args={"kind": "purchase", "day": __import__("datetime").date(2024, 1, 15), "least": 10}, events=t.events)


@query("sel_map_values", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
def sel_map_values(t: Tables):
    codes = F.create_map(F.lit("O"), F.lit(1), F.lit("F"), F.lit(2))
    return t.orders.select("o_orderkey", F.try_element_at(codes, F.col("o_orderstatus")).alias("code"))


# --- joins ---------------------------------------------------------------------------------------
sql_query("join_inner", "SELECT c_custkey, n_name, r_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey", ["customer", "nation", "region"])
sql_query("join_left_count", "SELECT n_name, count(s_suppkey) AS suppliers, count(*) AS all_rows FROM {nation} LEFT JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 9000) s ON n_nationkey = s_nationkey GROUP BY n_name", ["nation", "supplier"])
sql_query("join_right_coalesce", "SELECT coalesce(s_name, 'none') AS s_name, n_name FROM (SELECT * FROM {supplier} WHERE s_acctbal < 0) s RIGHT JOIN {nation} ON s_nationkey = n_nationkey", ["nation", "supplier"])
sql_query("join_full", "SELECT a.k AS a_k, b.k AS b_k, a.n AS a_n, b.n AS b_n FROM (SELECT p_size AS k, count(*) AS n FROM {part} WHERE p_size < 30 GROUP BY p_size) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) b ON a.k = b.k", ["part", "customer"])
sql_query("join_cross_count", "SELECT count(*) AS n FROM {nation} CROSS JOIN {region} CROSS JOIN (SELECT DISTINCT p_brand FROM {part}) b", ["nation", "region", "part"])
sql_query("join_self_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", ["supplier"])
sql_query("join_natural_using", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM {nation}) NATURAL JOIN (SELECT c_nationkey AS k, max(c_acctbal) AS y FROM {customer} GROUP BY c_nationkey) JOIN (SELECT s_nationkey AS k FROM {supplier} GROUP BY s_nationkey) USING (k)", ["nation", "customer", "supplier"])
sql_query("join_theta_derived", "SELECT c_custkey, a.c_nationkey FROM {customer} c, (SELECT c_nationkey, avg(c_acctbal) AS m FROM {customer} GROUP BY c_nationkey) a WHERE c.c_nationkey = a.c_nationkey AND c.c_acctbal > 1.5 * a.m", ["customer"])
sql_query("semi_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000)", ["customer", "orders"])
sql_query("semi_tuple_in", "SELECT p_partkey FROM {part} WHERE (p_brand, p_retailprice) IN (SELECT p_brand, max(p_retailprice) FROM {part} GROUP BY p_brand)", ["part"])
sql_query("anti_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 150000)", ["customer", "orders"])
sql_query("anti_not_in_null", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM {supplier})", ["nation", "supplier"])
sql_query("anti_not_in", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 8000)", ["nation", "supplier"])


@query("join_range_price_band", "WITH bands AS (SELECT p_brand, min(p_retailprice) AS lo, min(p_retailprice) + 20 AS hi FROM part GROUP BY p_brand) SELECT p.p_partkey, b.p_brand AS band FROM part p JOIN bands b ON p.p_retailprice BETWEEN b.lo AND b.hi")
def join_range_price_band(t: Tables):
    bands = t.part.groupBy(F.col("p_brand").alias("band")).agg(F.min("p_retailprice").alias("lo")).withColumn("hi", F.col("lo") + 20)
    return R.band_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 20).select("p_partkey", "band")


@query("join_as_of", "SELECT e.event_id, (SELECT max_by(p.value, p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'signup'")
def join_as_of(t: Tables):
    buys = t.events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    signups = t.events.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    return R.as_of_join(signups, buys.withColumnRenamed("ts", "at"), "user_id", "ts", "at", "last_purchase").select("event_id", "last_purchase")


@query("lookup_array", "SELECT n_nationkey, CAST(count(s_suppkey) AS BIGINT) AS n, coalesce(string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def lookup_array(t: Tables):
    joined = R.lookup_array(t.nation, t.supplier.select("s_nationkey", "s_suppkey", "s_name"), "n_nationkey", "s_nationkey", "suppliers")
    return joined.select("n_nationkey", F.size("suppliers").cast("long").alias("n"), F.array_join(F.transform("suppliers", lambda s: F.concat(s["s_suppkey"].cast("string"), F.lit(":"), s["s_name"])), ",").alias("suppliers"))


@query("rule_grandparents", "WITH e AS (SELECT c_custkey AS child, c_custkey // 4 AS parent FROM customer WHERE c_custkey > 0) SELECT a.child, b.parent AS grandparent FROM e a JOIN e b ON a.parent = b.child")
def rule_grandparents(t: Tables):
    e = t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 4").alias("parent"))
    return e.alias("a").join(e.alias("b"), F.col("a.parent") == F.col("b.child")).select("a.child", F.col("b.parent").alias("grandparent"))


@query("rule_cousins", "WITH e AS (SELECT s_suppkey AS child, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey > 0) SELECT x.child AS a, y.child AS b FROM e x JOIN e y ON x.child < y.child AND x.parent <> y.parent JOIN e p ON p.child = x.parent JOIN e q ON q.child = y.parent AND p.parent = q.parent")
def rule_cousins(t: Tables):
    e = t.supplier.where("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.expr("s_suppkey div 3").alias("parent"))
    up = e.join(e.toDF("parent", "grandparent"), "parent")
    return up.alias("x").join(up.alias("y"), "grandparent").where("x.child < y.child AND x.parent <> y.parent").select(F.col("x.child").alias("a"), F.col("y.child").alias("b"))


# --- subqueries ----------------------------------------------------------------------------------
sql_query("scalar_sub", "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) + 3000 FROM {customer})", ["customer"])
sql_query("scalar_sub_select", "SELECT n_name, (SELECT count(*) FROM {customer}) AS all_customers FROM {nation}", ["nation", "customer"])
sql_query("corr_scalar", "SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM {customer} i WHERE i.c_nationkey = o.c_nationkey), 4) AS diff FROM {customer} o WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} i WHERE i.c_nationkey = o.c_nationkey)", ["customer"])
sql_query("having_sub", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM {customer} GROUP BY c_nationkey HAVING sum(c_acctbal) > (SELECT sum(c_acctbal) / 25 FROM {customer})", ["customer"])
sql_query("multi_cte", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey), b AS (SELECT max(n) AS m FROM a) SELECT n_name, n FROM a JOIN b ON n = m JOIN {nation} ON k = n_nationkey", ["customer", "nation"])


@query("corr_rank_count", "SELECT s_suppkey, s_acctbal FROM supplier a WHERE (SELECT count(*) FROM supplier b WHERE b.s_acctbal > a.s_acctbal) < 3")
def corr_rank_count(t: Tables):
    return R.top_n_per_group(t.supplier, [], [F.desc("s_acctbal")], 3).select("s_suppkey", "s_acctbal")


@query("orderby_sub_rewrite", "SELECT c_custkey, n_name, CAST(row_number() OVER (ORDER BY n, n_name, c_custkey) AS INTEGER) AS pos FROM customer JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) ON k = c_nationkey JOIN nation ON n_nationkey = k")
def orderby_sub_rewrite(t: Tables):
    sizes = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = t.customer.join(sizes, "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.next_values(rows, ["n", "n_name", "c_custkey"], "pos").select("c_custkey", "n_name", F.col("pos").cast("int").alias("pos"))


@query("recursive_levels", "WITH RECURSIVE e AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey > 0 THEN s_suppkey // 5 END AS p FROM supplier), t AS (SELECT n, 1 AS level, [n] AS path FROM e WHERE p IS NULL UNION ALL SELECT e.n, t.level + 1, list_append(t.path, e.n) FROM t JOIN e ON e.p = t.n) SELECT n AS node, level, array_to_string(path, '/') AS path, repeat('  ', level - 1) || n AS shown FROM t")
def recursive_levels(t: Tables):
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") > 0, F.expr("s_suppkey div 5")).alias("parent"))
    tree = R.hierarchy(nodes, "node", "parent")
    return tree.select("node", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("node").cast("string")).alias("shown"))


# --- aggregation ---------------------------------------------------------------------------------
sql_query("agg_global", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(max(o_totalprice) - min(o_totalprice), 2) AS spread, count(*) AS n FROM {orders}", ["orders"])
sql_query("agg_group_having", "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS m, count(*) AS n FROM {orders} GROUP BY o_orderpriority, o_orderstatus HAVING count(*) > 10", ["orders"])
sql_query("agg_null_groups", "SELECT c_mktsegment, round(sum(nullif(c_acctbal, abs(c_acctbal))) + sum(c_acctbal), 2) AS s, count(nullif(c_acctbal, abs(c_acctbal))) AS negatives FROM {customer} GROUP BY c_mktsegment", ["customer"])
sql_query("agg_by_expression", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(length(o_orderpriority) AS BIGINT) AS l, count(*) AS n FROM {orders} GROUP BY year(o_orderdate), length(o_orderpriority)", ["orders"])
sql_query("nested_agg", "SELECT max(s) AS top FROM (SELECT round(sum(o_totalprice), 2) AS s FROM {orders} GROUP BY o_custkey)", ["orders"])
sql_query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus", ["lineitem"])
sql_query("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", ["orders"])
sql_query("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type", ["events"])
sql_query("listagg", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name", ["nation", "region"],
          "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql_query("agg_moments", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS vp FROM {customer} GROUP BY c_mktsegment", ["customer"])


@query("group_argmax_ties", "SELECT p_brand, p_partkey, p_size FROM part JOIN (SELECT p_brand, max(p_size) AS m FROM part GROUP BY p_brand) USING (p_brand) WHERE p_size = m")
def group_argmax_ties(t: Tables):
    return R.arg_max_rows(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size")


@query("points_table", "WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders) SELECT o_custkey, CAST(sum(CASE pos WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 END) AS BIGINT) AS points FROM r WHERE pos <= 3 GROUP BY o_custkey")
def points_table(t: Tables):
    points = F.create_map(*[F.lit(x) for x in (1, 25, 2, 18, 3, 15)])
    months = t.orders.withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate")})
    best = R.top_n_per_group(months, ["y", "m"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, ties=False)
    return best.groupBy("o_custkey").agg(F.sum(points[F.col("rank")]).cast("long").alias("points"))


# --- windows, order, sets ------------------------------------------------------------------------
@query("deviation_window", "SELECT n_name, c_custkey, round(c_acctbal - m, 4) AS above FROM customer JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1) ON k = c_nationkey JOIN nation ON n_nationkey = k WHERE c_acctbal > m")
def deviation_window(t: Tables):
    rows = R.deviation_from_group(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", "above").where("above > 0")
    return rows.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", rounded(F.col("above"), 4).alias("above"))  # 25 nations


DAILY = "SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM {events} GROUP BY CAST(ts AS DATE)"
sql_query("moving_avg", f"SELECT CAST(d AS STRING) AS d, round(avg(n) OVER (ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS m FROM ({DAILY})", ["events"],
          f"SELECT CAST(d AS VARCHAR) AS d, round(avg(n) OVER (ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 6) AS m FROM ({DAILY.format(events='events')})")
sql_query("running_sum", f"SELECT CAST(d AS STRING) AS d, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS upto, CAST(n - 2 * lag(n) OVER (ORDER BY d) + lag(n, 2) OVER (ORDER BY d) AS BIGINT) AS second_difference FROM ({DAILY})", ["events"],
          f"SELECT CAST(d AS VARCHAR) AS d, CAST(sum(n) OVER (ORDER BY d) AS BIGINT) AS upto, CAST(n - 2 * lag(n) OVER (ORDER BY d) + lag(n, 2) OVER (ORDER BY d) AS BIGINT) AS second_difference FROM ({DAILY.format(events='events')})")
sql_query("rank_in_group", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS k FROM {customer}", ["customer"])
sql_query("topk", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", ["orders"])
sql_query("offset_page", "SELECT p_partkey, p_name FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20", ["part"])
sql_query("intersect", "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier}", ["customer", "supplier"])
sql_query("except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000", ["nation", "supplier"])
sql_query("union_all_bands", "SELECT c_custkey, 'low' AS band FROM {customer} WHERE c_acctbal < 1000 UNION ALL SELECT c_custkey, 'middle' FROM {customer} WHERE c_acctbal BETWEEN 1000 AND 5000 UNION ALL SELECT c_custkey, 'high' FROM {customer} WHERE c_acctbal > 5000", ["customer"])


@query("cursor_from_end", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1 OFFSET 1")
def cursor_from_end(t: Tables):
    from quarry.sources.tables import relative_row

    return relative_row(t.orders.select("o_orderkey"), ["o_orderkey"], -2)


@query("concat_by_name", "SELECT n_name, NULL AS r_name, n_nationkey AS k FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
def concat_by_name(t: Tables):
    return t.nation.select("n_name", F.col("n_nationkey").alias("k")).unionByName(t.region.select("r_name", F.col("r_regionkey").alias("k")), allowMissingColumns=True)


# --- rows as new tables --------------------------------------------------------------------------
@query("update_join", "SELECT c_custkey, round(CASE WHEN m IS NOT NULL THEN m ELSE c_acctbal END, 4) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def update_join(t: Tables):
    new = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return R.update_from(t.customer.select("c_custkey", "c_acctbal"), new, "c_custkey", "c_acctbal").withColumn("c_acctbal", rounded(F.col("c_acctbal"), 4))


@query("delete_anti", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_anti(t: Tables):
    victims = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.delete_matching(t.orders, victims, "o_custkey").select("o_orderkey")


@query("sequence_fill", "SELECT s_suppkey, CAST(1000 + 10 * (row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) AS BIGINT) AS number FROM supplier")
def sequence_fill(t: Tables):
    return R.next_values(t.supplier, ["s_acctbal", "s_suppkey"], "number", 1000, 10).select("s_suppkey", "number")


@query("constraint_violations", """SELECT 'unique c_name' AS "constraint", CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM customer GROUP BY c_name HAVING count(*) > 1)
    UNION ALL SELECT 'not null c_nationkey', count(*) FILTER (WHERE c_nationkey IS NULL) FROM customer UNION ALL SELECT 'check positive', count(*) FILTER (WHERE NOT c_acctbal >= 0) FROM customer
    UNION ALL SELECT 'foreign key c_nationkey', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")  # fmt: skip
def constraint_violations(t: Tables):
    return R.violations(t.customer, ["c_name"], ["c_nationkey"], {"positive": F.col("c_acctbal") >= 0}, {"c_nationkey": (t.nation.where("n_regionkey < 3"), "n_nationkey")})


@query("cascade", "SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_nationkey >= 5 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def cascade(t: Tables):
    victims = t.nation.where("n_nationkey < 5").select("n_nationkey")
    _, customers, orders = R.cascade_delete([(t.nation, "n_nationkey", None), (t.customer, "c_custkey", "c_nationkey"), (t.orders, "o_orderkey", "o_custkey")], victims)
    counted = lambda df, name: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return counted(customers, "customer").unionByName(counted(orders, "orders"))


@query("slices", "SELECT * FROM (SELECT 'label' AS kind, p_partkey FROM part WHERE p_partkey BETWEEN 10 AND 20) UNION ALL (SELECT 'position', p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 10)")
def slices(t: Tables):
    rows = t.part.select("p_partkey")
    return R.label_slice(rows, "p_partkey", 10, 20).select(F.lit("label").alias("kind"), "p_partkey").union(R.position_slice(rows, "p_partkey", 10, 20).select(F.lit("position"), "p_partkey"))


@query("count_in_range", "SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'view' GROUP BY 1")
def count_in_range(t: Tables):
    inside = (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))
    return t.events.where(inside & (F.col("event_type") == "view")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("next_id", "SELECT CAST(max(o_orderkey) + 1 AS BIGINT) AS next_id FROM orders")
def next_id(t: Tables):
    return R.next_id(t.orders, "o_orderkey")


@query("check_option", "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_acctbal, abs(c_acctbal)) < 0, false)")
def check_option(t: Tables):
    return R.check_option(t.customer, F.nullif("c_acctbal", F.abs("c_acctbal")) < 0).select("c_custkey")


@query("guarded_delete", "SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def guarded_delete(t: Tables):
    childless = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"), "left_anti")
    return R.guarded_delete(t.region, "r_regionkey", childless, t.nation, "n_regionkey").select("r_regionkey")


@query("audited_update", "SELECT s_suppkey, 'update' AS action, round(s_acctbal, 2) AS before, round(s_acctbal + 100, 2) AS after FROM supplier WHERE s_acctbal < 0")
def audited_update(t: Tables):
    new = t.supplier.withColumn("s_acctbal", F.when(F.col("s_acctbal") < 0, F.col("s_acctbal") + 100).otherwise(F.col("s_acctbal")))
    log = R.audited(t.supplier, new, "s_suppkey", ["s_acctbal"])
    return log.select("s_suppkey", "action", rounded(F.col("old.s_acctbal"), 2).alias("before"), rounded(F.col("new.s_acctbal"), 2).alias("after"))


@query("stratified_bands", "SELECT o_custkey, CASE WHEN n >= 15 THEN 'often' WHEN n >= 8 THEN 'sometimes' ELSE 'seldom' END AS band FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def stratified_bands(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", F.when(F.col("n") >= 15, "often").when(F.col("n") >= 8, "sometimes").otherwise("seldom").alias("band"))
