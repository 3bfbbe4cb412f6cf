"""Queries over frames: labels, kinds of columns, alignment, samples, arrays, scaling fitted elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import frame as E
from quarry.operators import relational as R
from quarry.plans.registry import Tables, query, rounded, sql_query
from quarry.sources import tables as S

sql_query("sel_like_exact", "SELECT p_partkey FROM {part} WHERE p_brand LIKE 'Brand#1' OR p_brand NOT LIKE 'Brand%'", ["part"])
sql_query("join_self_dates", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE abs(datediff(CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 30", ["orders"],
          "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE abs(date_diff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE))) <= 30")
sql_query("regex_groups", r"SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#?([0-9]+)$', 1) AS word, regexp_extract(c_name, '^([A-Za-z]+)#?([0-9]+)$', 2) AS number, regexp_replace(c_name, '([0-9])([0-9])', '$2$1') AS swapped FROM {customer}".replace("\\", "\\\\"), ["customer"],
          r"SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#?([0-9]+)$', 1) AS word, regexp_extract(c_name, '^([A-Za-z]+)#?([0-9]+)$', 2) AS number, regexp_replace(c_name, '([0-9])([0-9])', '\2\1', 'g') AS swapped FROM customer")
sql_query("sel_sha1", "SELECT c_custkey, sha1(c_name) AS s, sha2(c_name, 256) AS l FROM {customer}", ["customer"], "SELECT c_custkey, sha1(c_name) AS s, sha256(c_name) AS l FROM customer")
sql_query("temperature", "SELECT event_id, round(value * 9 / 5 + 32, 6) AS fahrenheit, round((value - 32) * 5 / 9, 6) AS celsius FROM {events}", ["events"])
sql_query("agg_filtered_regex", "SELECT event_type, count(*) AS n FROM {events} WHERE event_type RLIKE '^(cl|vi)' OR (event_type NOT IN ('error', 'signup') AND value > 90) GROUP BY event_type", ["events"],
          "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, '^(cl|vi)') OR (event_type NOT IN ('error', 'signup') AND value > 90) GROUP BY event_type")


@query("hash_digests")
def hash_digests(t: Tables):
    return t.nation.select("n_name", F.sha2("n_name", 512).alias("sha512"), F.sha1("n_name").alias("sha1"), X.sha3_256(F.col("n_name")).alias("sha3"))


@query("dedup_keep_last", "SELECT c_nationkey, c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def dedup_keep_last(t: Tables):
    return E.deduplicated(t.customer.select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], ["c_custkey"], "last")


@query("drop_labels", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (2, 5, 11)")
def drop_labels(t: Tables):
    return E.without_labels(t.nation.select("n_nationkey", "n_name"), "n_nationkey", [2, 5, 11])


@query("select_dtypes", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_dtypes(t: Tables):
    return E.of_kind(t.part, "number")


@query("select_objects", "SELECT p_name, p_brand, p_type FROM part")
def select_objects(t: Tables):
    return E.of_kind(t.part, "object", "datetime")


@query("projection_exclusion", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def projection_exclusion(t: Tables):
    return E.projected(t.customer, {"c_acctbal": 0}, "c_custkey")


@query("projection_inclusion", "SELECT c_name, c_acctbal FROM customer")
def projection_inclusion(t: Tables):
    return E.projected(t.customer, {"c_name": 1, "c_acctbal": 1, "c_custkey": 0}, "c_custkey")


@query("array_none_of", "SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag))[1] AS first_flag FROM lineitem GROUP BY 1 HAVING NOT list_has_any(list(l_returnflag), ['R', 'A'])")
def array_none_of(t: Tables):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return lists.where(~F.arrays_overlap("flags", F.array(F.lit("R"), F.lit("A")))).select("l_orderkey", F.array_min("flags").alias("first_flag"))


@query("array_sets", "WITH a AS (SELECT o_custkey, list_sort(list(DISTINCT month(o_orderdate)) FILTER (WHERE o_orderstatus = 'F')) AS f, list_sort(list(DISTINCT month(o_orderdate)) FILTER (WHERE o_orderstatus = 'O')) AS o FROM orders GROUP BY 1) SELECT o_custkey, CAST(len(list_intersect(coalesce(f, []), coalesce(o, []))) AS INTEGER) AS both, CAST(len(coalesce(f, [])) - len(list_intersect(coalesce(f, []), coalesce(o, []))) AS INTEGER) AS only_f, list_has_all(coalesce(o, []), coalesce(f, [])) AS subset FROM a")
def array_sets(t: Tables):
    month = F.month("o_orderdate")
    a = t.orders.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", month)).alias("f"), F.collect_set(F.when(F.col("o_orderstatus") == "O", month)).alias("o"))
    return a.select("o_custkey", F.size(F.array_intersect("f", "o")).alias("both"), F.size(F.array_except("f", "o")).alias("only_f"), (F.size(F.array_except("f", "o")) == 0).alias("subset"))


@query("array_flatten", "SELECT o_custkey, CAST(sum(n) AS BIGINT) AS lines, CAST(max(m) AS INTEGER) AS last_line FROM (SELECT o_custkey, o_orderkey, count(l_linenumber) AS n, max(l_linenumber) AS m FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def array_flatten(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    nested = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.flatten(F.collect_list("lines")).alias("all"))
    return nested.select("o_custkey", F.size("all").cast("long").alias("lines"), F.array_max("all").alias("last_line"))


@query("array_reshape", "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(e[2], 4) AS first_row_second, round(e[9], 4) AS transposed_first_second, round(e[64] + e[1], 4) AS ends, CAST(len(e) // 8 AS INTEGER) AS height FROM a")
def array_reshape(t: Tables):
    e = t.embeddings.select("vec_id", E.reshaped(F.transform("embedding", lambda x: x.cast("double")), 8).alias("m"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    turned = E.transposed(F.col("m"))
    ends = E.gathered(F.col("e"), F.array(F.lit(63), F.lit(0)))
    return e.select("vec_id", rounded(F.col("m")[0][1], 4).alias("first_row_second"), rounded(turned[0][1], 4).alias("transposed_first_second"), rounded(ends[0] + ends[1], 4).alias("ends"), F.size("m").alias("height"))


@query("argsort_rows", "SELECT vec_id, CAST((list_grade_up(embedding::DOUBLE[]))[1] - 1 AS INTEGER) AS least_at, CAST((list_grade_up(embedding::DOUBLE[]))[64] - 1 AS INTEGER) AS most_at FROM embeddings")
def argsort_rows(t: Tables):
    order = E.argsort(F.transform("embedding", lambda x: x.cast("double")))
    return t.embeddings.select("vec_id", order[0].alias("least_at"), order[63].alias("most_at"))


@query("aligned_sum", "SELECT coalesce(a.k, b.k) AS k, a.n + b.n AS n FROM (SELECT p_size AS k, count(*) AS n FROM part GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
def aligned_sum(t: Tables):
    a = t.part.groupBy(F.col("p_size").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return E.aligned(a, b, "k", "n", lambda x, y: x + y)


@query("side_by_side", "SELECT a.n_name, b.s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) a FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) b USING (k)")
def side_by_side(t: Tables):
    return E.side_by_side(t.nation, ["n_nationkey"], t.supplier, ["s_acctbal", "s_suppkey"]).select("n_name", "s_name")


@query("row_stats", "SELECT l_orderkey, l_linenumber, round((coalesce(nullif(l_quantity, 1), 0) + l_discount + l_tax) / (2 + CAST(l_quantity <> 1 AS INTEGER)), 6) AS mean, round(coalesce(nullif(l_quantity, 1), 0) + l_discount + l_tax, 6) AS total FROM lineitem")
def row_stats(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(1.0)).alias("q"), F.when(F.col("l_quantity") == 1, float("nan")).otherwise(0.0).alias("z"), "l_discount", "l_tax")
    with_nan = rows.withColumn("q", F.coalesce("q", "z"))
    return with_nan.select("l_orderkey", "l_linenumber", rounded(E.row_mean(["q", "l_discount", "l_tax"])).alias("mean"), rounded(E.nan_sum(["q", "l_discount", "l_tax"])).alias("total"))


@query("null_by_group", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal < 0) AS c_acctbal, count(*) FILTER (WHERE c_nationkey > 20) AS c_nationkey FROM customer GROUP BY 1")
def null_by_group(t: Tables):
    holes = t.customer.select("c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("c_nationkey"))
    return E.nulls_by_group(holes, "c_mktsegment", ["c_acctbal", "c_nationkey"])


@query("dropna_variants", "WITH h AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS a, CASE WHEN c_nationkey <= 20 THEN c_nationkey END AS b FROM customer) SELECT 'any' AS how, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n FROM h UNION ALL SELECT 'all', count(*) FILTER (WHERE a IS NOT NULL OR b IS NOT NULL) FROM h UNION ALL SELECT 'subset', count(b) FROM h UNION ALL SELECT 'two', count(*) FILTER (WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT >= 2) FROM h")
def dropna_variants(t: Tables):
    holes = t.customer.select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("b"))
    forms = {"any": E.without_nulls(holes), "all": E.without_nulls(holes, "all"), "subset": E.without_nulls(holes, columns=["b"]), "two": E.without_nulls(holes, least=2)}
    counts = [df.agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n")) for how, df in forms.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("fill_mode", "WITH m AS (SELECT nullif(c_mktsegment, 'BUILDING') AS s FROM customer), f AS (SELECT s FROM m WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1) SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), (SELECT s FROM f)) AS segment FROM customer")
def fill_mode(t: Tables):
    holes = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return E.filled(holes, "segment", "mode")


@query("ordered_category", "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS place FROM orders")
def ordered_category(t: Tables):
    return t.orders.select("o_orderkey", E.ordered_category("o_orderpriority", ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]).cast("int").alias("place"))


@query("seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':' || '7'), c_custkey LIMIT 100")
def seeded_sample(t: Tables):
    return E.hashed_sample(t.customer.select("c_custkey"), "c_custkey", 100, 7)


@query("random_choice", "SELECT event_id, ['red', 'green', 'blue'][1 + CAST(ascii(md5(event_id || ':3')) AS INTEGER) % 3] AS colour FROM events")
def random_choice(t: Tables):
    at = F.ascii(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit("3")))) % 3
    return t.events.select("event_id", F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), at + 1).alias("colour"))


@query("scale_train_test", "WITH f AS (SELECT min(value) AS lo, max(value) - min(value) AS w, avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_type <> 'view') SELECT event_id, round((value - lo) / w, 6) AS scaled, round((value - m) / s, 6) AS z FROM events, f WHERE event_type = 'view'")
def scale_train_test(t: Tables):
    train, rows = t.events.where("event_type <> 'view'"), t.events.where("event_type = 'view'").select("event_id", "value")
    both = E.fitted_scaling(train, E.fitted_scaling(train, rows, "value", "scaled"), "value", "z", "zscore")
    return both.select("event_id", rounded(F.col("scaled")).alias("scaled"), rounded(F.col("z")).alias("z"))


@query("money_cast", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def money_cast(t: Tables):
    shown = F.concat(F.lit("$ "), F.format_number(F.col("c_acctbal"), 2))
    return t.customer.select("c_custkey", E.money(shown).alias("amount"))


@query("sentence_split", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '' AND NOT regexp_full_match(s, '\s*'))) AS INTEGER) AS sentences FROM documents")
def sentence_split(t: Tables):
    return t.documents.select("doc_id", F.size(F.filter(X.sentences(F.col("text")), lambda s: ~s.rlike(r"^\s*$"))).alias("sentences"))


@query("factorials", "SELECT p_size, count(*) AS n, CAST(factorial(min(p_size)::INTEGER) AS DOUBLE) AS f FROM part WHERE p_size <= 20 GROUP BY 1")
def factorials(t: Tables):
    return t.part.where("p_size <= 20").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).withColumn("f", E.factorial(F.col("p_size")))


@query("sieve_primes", "SELECT CAST(x AS BIGINT) AS prime FROM range(2, 2001) t(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(y) WHERE y < x AND x % y = 0)")
def sieve_primes(t: Tables):
    return E.primes_up_to(t.region, 2000)


@query("piped_steps", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS m FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 2")
def piped_steps(t: Tables):
    at_least = lambda df, least: df.where(F.col("n") > least)
    means = lambda df: df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("c_acctbal"), 4).alias("m"))
    return t.customer.where("c_acctbal > 0").transform(means).transform(at_least, 2).drop("n")


@query("years_since", "SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-30') / 365.25) AS BIGINT) AS years FROM orders")
def years_since(t: Tables):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION years_since(d DATE, today DATE DEFAULT DATE'2024-06-30') RETURNS BIGINT RETURN CAST(floor(datediff(today, d) / 365.25D) AS BIGINT)")
    return t.spark.sql("SELECT o_orderkey, years_since(CAST(o_orderdate AS DATE)) AS years FROM {o}", o=t.orders)


@query("recursive_siblings", "WITH RECURSIVE e AS (SELECT s_suppkey AS n, s_name AS name, CASE WHEN s_suppkey > 0 THEN s_suppkey // 5 END AS p FROM supplier), t AS (SELECT n, 1 AS level, [name] AS path FROM e WHERE p IS NULL UNION ALL SELECT e.n, t.level + 1, list_append(t.path, e.name) FROM t JOIN e ON e.p = t.n) SELECT n AS node, level, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS place FROM t")
def recursive_siblings(t: Tables):
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") > 0, F.expr("s_suppkey div 5")).alias("parent"))
    tree = R.hierarchy(nodes, "node", "parent", label="name")
    return R.next_values(tree, ["path"], "place").select("node", "level", "place")


@query("recursive_cascade", "WITH RECURSIVE e AS (SELECT s_suppkey AS n, CASE WHEN s_suppkey > 0 THEN s_suppkey // 5 END AS p FROM supplier), gone AS (SELECT n FROM e WHERE n = 2 UNION ALL SELECT e.n FROM e JOIN gone ON e.p = gone.n) SELECT n AS node FROM e WHERE n NOT IN (SELECT n FROM gone)")
def recursive_cascade(t: Tables):
    nodes = t.supplier.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") > 0, F.expr("s_suppkey div 5")).alias("parent"))
    return R.delete_subtrees(nodes, "node", "parent", t.spark.range(2, 3).toDF("node")).select("node")


@query("filled_ids", "SELECT s_name, CAST(coalesce(CASE WHEN s_acctbal >= 0 THEN s_suppkey END, 1000000 + row_number() OVER (PARTITION BY s_acctbal < 0 ORDER BY s_suppkey)) AS BIGINT) AS id, coalesce(nullif(s_nationkey, 3), -1) AS s_nationkey FROM supplier")
def filled_ids(t: Tables):
    rows = t.supplier.select("s_name", "s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey")).alias("id"), F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey"))
    return R.with_defaults(rows, "id", ["s_suppkey"], 1_000_001, {"s_nationkey": -1}).select("s_name", "id", "s_nationkey")


@query("maintained_counts", "SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT * FROM customer WHERE c_acctbal > 9000) c ON c_nationkey = n_nationkey GROUP BY 1")
def maintained_counts(t: Tables):
    counts = t.nation.select("n_nationkey").join(t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")), "n_nationkey", "left").fillna(0)
    key = F.col("c_nationkey").alias("n_nationkey")
    return R.adjusted_counts(counts, "n_nationkey", "n", t.customer.where("c_acctbal > 9000").select(key), t.customer.where("c_acctbal < 0").select(key))


@query("cursor_moves", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT 1 AS step, o_orderkey FROM o WHERE k = 1 UNION ALL SELECT 2, o_orderkey FROM o WHERE k = 4 UNION ALL SELECT 3, o_orderkey FROM o WHERE k = 3 UNION ALL SELECT 4, o_orderkey FROM o WHERE k = n UNION ALL SELECT 5, o_orderkey FROM o WHERE k = n - 5")
def cursor_moves(t: Tables):
    return S.cursor_walk(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], [("first", 0), ("relative", 3), ("prior", 0), ("last", 0), ("relative", -5)]).select("step", "o_orderkey")


@query("rule_parameter", "WITH RECURSIVE e AS (SELECT c_custkey AS child, c_custkey // 4 AS parent FROM customer WHERE c_custkey > 0), up AS (SELECT child, parent, 1 AS d FROM e WHERE child = 777 UNION ALL SELECT e.child, e.parent, d + 1 FROM up JOIN e ON e.child = up.parent) SELECT parent AS ancestor, d AS distance FROM up")
def rule_parameter(t: Tables):
    e = t.customer.where("c_custkey > 0").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 4").alias("parent"))
    return R.ancestors(e, "child", "parent", 777)
