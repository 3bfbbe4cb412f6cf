"""Queries of mining, statistics and evaluation: baskets, clusterings, Bayes, regression, validation, spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.operators import mining as M
from quarry.operators import stats as S
from quarry.operators import vector as V
from quarry.plans.registry import Tables, query, rounded


@query("basket_onehot", "SELECT l_orderkey, CAST(max(l_returnflag = 'A') AS INTEGER) AS \"A\", CAST(max(l_returnflag = 'N') AS INTEGER) AS \"N\", CAST(max(l_returnflag = 'R') AS INTEGER) AS \"R\" FROM lineitem GROUP BY 1")
def basket_onehot(t: Tables):
    return M.one_hot_baskets(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N", "R"])


FLAGS = "SELECT l_orderkey, list_sort(list_concat(list(DISTINCT l_returnflag), list(DISTINCT l_linestatus))) AS has FROM lineitem GROUP BY 1"
SUBSETS = f"WITH b AS ({FLAGS}), m AS (SELECT unnest(range(1, 32)) AS m), s AS (SELECT m, list_filter(['A', 'F', 'N', 'O', 'R'], lambda x, i: (m >> (i - 1)::INTEGER) & 1 = 1) AS items FROM m), f AS (SELECT m, items, count(*) AS n, count(*) / (SELECT count(*) FROM b) AS s FROM s JOIN b ON list_has_all(has, items) GROUP BY 1, 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM b))"


def flag_baskets(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("basket"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("item"))


@query("itemsets_all_sizes", f"{SUBSETS} SELECT array_to_string(items, ',') AS items, n, round(s, 6) AS support FROM f")
def itemsets_all_sizes(t: Tables):
    sets = M.frequent_itemsets(flag_baskets(t), 0.05)
    return sets.select(F.array_join("items", ",").alias("items"), "n", rounded(F.col("support")).alias("support"))


@query("rules_all_sizes", f"{SUBSETS} SELECT array_to_string(a.items, ',') AS antecedent, array_to_string(c.items, ',') AS consequent, round(w.s, 6) AS support, round(w.s / a.s, 6) AS confidence, round(w.s / a.s / c.s, 6) AS lift FROM f w JOIN f a ON (a.m & w.m) = a.m AND a.m <> w.m JOIN f c ON c.m = w.m - a.m WHERE w.s / a.s >= 0.3")
def rules_all_sizes(t: Tables):
    rules = M.association_rules(M.frequent_itemsets(flag_baskets(t), 0.05), 0.3)
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), *[rounded(F.col(c)).alias(c) for c in ("support", "confidence", "lift")])


COSTS = "SELECT k, sum(n * v) AS cost FROM (SELECT k, least(floor((p_retailprice - lo) / (hi - lo) * k), k - 1) AS b, count(*) AS n, var_pop(p_retailprice) AS v FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), (SELECT unnest(range(1, 11)) AS k) GROUP BY 1, 2) GROUP BY 1"


@query("elbow_point", f"WITH c AS ({COSTS}), e AS (SELECT min_by(cost, k) AS c1, max_by(cost, k) AS c2 FROM c) SELECT CAST(k AS INTEGER) AS k, round(cost, 1) AS cost, round(abs((c2 - c1) * (k - 1) - 9 * (cost - c1)) / sqrt(pow(c2 - c1, 2) + 81), 4) AS distance, round(lead(cost) OVER (ORDER BY k) - 2 * cost + lag(cost) OVER (ORDER BY k), 1) AS second_difference FROM c, e")
def elbow_point(t: Tables):
    lo, hi = t.part.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    each = t.part.select("p_retailprice", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    bins = each.groupBy("k", F.least(F.floor((F.col("p_retailprice") - lo) / (hi - lo) * F.col("k")), F.col("k") - 1).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.var_pop("p_retailprice").alias("v"))
    found = M.elbow(bins.groupBy("k").agg(F.sum(F.col("n") * F.col("v")).alias("cost")))
    return found.select("k", rounded(F.col("cost"), 1).alias("cost"), rounded(F.col("distance"), 4).alias("distance"), rounded(F.col("second_difference"), 1).alias("second_difference"))


@query("cluster_agreement", "WITH c AS (SELECT label AS a, CAST(embedding[1] > 0 AS INTEGER) AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS t FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), k AS (SELECT sum(n * (n - 1) / 2) AS c FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((i - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 8) AS ari FROM i, r, k")
def cluster_agreement(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("a"), (F.col("embedding")[0] > 0).cast("int").alias("b"))
    return M.adjusted_rand(rows, "a", "b").select(rounded(F.col("ari"), 8).alias("ari"))


@query("davies_bouldin", "WITH p AS (SELECT p_retailprice AS x, p_size::DOUBLE AS y, p_size // 17 AS g FROM part), c AS (SELECT g, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), s AS (SELECT c.g, cx, cy, avg(sqrt(pow(x - cx, 2) + pow(y - cy, 2))) AS s FROM p JOIN c ON p.g = c.g GROUP BY 1, 2, 3) SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT max((a.s + b.s) / sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2))) AS w FROM s a JOIN s b ON a.g <> b.g GROUP BY a.g)")
def davies_bouldin(t: Tables):
    rows = t.part.select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"), F.expr("p_size div 17").alias("g"))
    return M.davies_bouldin(rows, ["x", "y"], "g").select(rounded(F.col("davies_bouldin")).alias("davies_bouldin"))


@query("k_distances", "SELECT query_id, round(value, 6) AS distance FROM (SELECT q.vec_id AS query_id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS value, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS k FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE k = 4")
def k_distances(t: Tables):
    near = V.nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings.select("vec_id", "embedding"), 4, "euclidean")
    return near.where("rank = 4").select("query_id", rounded(F.col("value")).alias("distance"))


FOLD = "ascii(md5(vec_id || ':5')) % 3"


@query("knn_choose_k", f"WITH r AS (SELECT *, {FOLD} AS fold FROM embeddings), n AS (SELECT q.vec_id AS q, q.label AS actual, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS k FROM r q JOIN r v ON q.fold <> v.fold), s AS (SELECT q, actual, label, k, m, row_number() OVER (PARTITION BY m, q, label ORDER BY k) AS votes FROM n, (SELECT unnest([1, 3, 5, 7]) AS m) WHERE k <= m), b AS (SELECT m, q, actual, label FROM s QUALIFY row_number() OVER (PARTITION BY m, q ORDER BY votes DESC, k) = 1) SELECT CAST(m AS INTEGER) AS k, round(avg(CAST(actual = label AS INTEGER)), 6) AS accuracy FROM b GROUP BY 1")
def knn_choose_k(t: Tables):
    rows = t.embeddings.withColumn("fold", F.ascii(F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit("5")))) % 3)
    return V.knn_accuracy(rows, [1, 3, 5, 7], "fold").select("k", rounded(F.col("accuracy")).alias("accuracy"))


@query("clamped_bayes", "WITH r AS (SELECT c_mktsegment AS y, CAST(c_acctbal > 0 AS INTEGER) AS a, CAST(c_custkey < 0 AS INTEGER) AS b, CAST(c_custkey >= 0 AS INTEGER) AS c FROM customer) SELECT y AS label, round(count(*) / (SELECT count(*) FROM customer), 6) AS prior, round(CASE avg(a) WHEN 0 THEN 0.01 WHEN 1 THEN 0.99 ELSE avg(a) END, 6) AS p_a, round(CASE avg(b) WHEN 0 THEN 0.01 WHEN 1 THEN 0.99 ELSE avg(b) END, 6) AS p_b, round(CASE avg(c) WHEN 0 THEN 0.01 WHEN 1 THEN 0.99 ELSE avg(c) END, 6) AS p_c FROM r GROUP BY 1")
def clamped_bayes(t: Tables):
    rows = t.customer.select(F.col("c_mktsegment").alias("y"), (F.col("c_acctbal") > 0).cast("int").alias("a"), (F.col("c_custkey") < 0).cast("int").alias("b"), (F.col("c_custkey") >= 0).cast("int").alias("c"))
    found = M.clamped_bayes(rows, ["a", "b", "c"], "y")
    return found.select("label", *[rounded(F.col(c)).alias(c) for c in found.columns[1:]])


@query("gaussian_likelihoods", "WITH m AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS p, avg(embedding[1]::DOUBLE) AS m1, stddev_pop(embedding[1]::DOUBLE) AS s1, avg(embedding[2]::DOUBLE) AS m2, stddev_pop(embedding[2]::DOUBLE) AS s2 FROM embeddings GROUP BY 1) SELECT vec_id, m.label, round(ln(p) - ln(s1 * sqrt(2 * pi())) - pow((embedding[1]::DOUBLE - m1) / s1, 2) / 2 - ln(s2 * sqrt(2 * pi())) - pow((embedding[2]::DOUBLE - m2) / s2, 2) / 2, 5) AS log_joint FROM embeddings, m")
def gaussian_likelihoods(t: Tables):
    rows = t.embeddings.select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in (0, 1)])
    found = M.gaussian_likelihoods(rows, rows.drop("label"), "vec_id", ["x0", "x1"], "label")
    return found.select("vec_id", "label", rounded(F.log("joint"), 5).alias("log_joint"))


@query("full_covariance_bayes", "WITH r AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT label, count(*) / (SELECT count(*) FROM r) AS p, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM r GROUP BY 1), j AS (SELECT vec_id, m.label, p * exp(-(vy * pow(x - mx, 2) - 2 * c * (x - mx) * (y - my) + vx * pow(y - my, 2)) / (vx * vy - c * c) / 2) / (2 * pi() * sqrt(vx * vy - c * c)) AS j FROM r, m) SELECT vec_id, label, round(j / sum(j) OVER (PARTITION BY vec_id), 6) AS p FROM j")
def full_covariance_bayes(t: Tables):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return M.full_covariance_posterior(rows, rows.drop("label"), "vec_id", "x", "y", "label").withColumn("p", rounded(F.col("p")))


@query("drop_correlated", "SELECT unnest(CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.5 THEN ['l_quantity', 'l_discount', 'l_tax'] ELSE ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'] END) AS feature FROM lineitem")
def drop_correlated(t: Tables):
    kept = M.uncorrelated(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.5)
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


GAIN = "SELECT '{f}' AS feature, (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderstatus)) - (SELECT sum(-n / t * log2(n / m)) FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {e}) AS m, sum(count(*)) OVER () AS t FROM orders GROUP BY {e}, o_orderstatus)) AS g"
FEATURES = {"priority": "o_orderpriority", "month": "month(o_orderdate)", "year": "year(o_orderdate)"}


@query("best_features", "SELECT feature, round(g, 8) AS gain FROM (" + " UNION ALL ".join(GAIN.format(f=f, e=e) for f, e in FEATURES.items()) + ") ORDER BY g DESC LIMIT 2")
def best_features(t: Tables):
    rows = t.orders.select("o_orderstatus", F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"))
    found = M.mutual_information(rows, "o_orderstatus", list(FEATURES))
    return found.orderBy(F.desc("gain")).limit(2).select("feature", rounded(F.col("gain"), 8).alias("gain"))


TWO = "c AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(y) AS yy FROM r), b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM c), f AS (SELECT *, my - bx * mx - bz * mz AS b0, n * (bx * xy + bz * zy) AS ssr, n * yy - n * (bx * xy + bz * zy) AS sse FROM b)"


@query("regression_table", f"WITH r AS (SELECT l_quantity AS x, l_discount AS z, l_extendedprice AS y FROM lineitem), {TWO} SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS factor, round(unnest([b0, bx, bz]), 3) AS coefficient, round(ssr / (ssr + sse), 6) AS r2, round((ssr / 2) / (sse / (n - 3)), 2) AS f FROM f")
def regression_table(t: Tables):
    found = S.regression_table(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"])
    return found.select("factor", rounded(F.col("coefficient"), 3).alias("coefficient"), rounded(F.col("r2")).alias("r2"), rounded(F.col("f"), 2).alias("f"))


@query("polynomial_fit", f"WITH r AS (SELECT (p_size - 25.0) / 25 AS x, pow((p_size - 25.0) / 25, 2) AS z, p_retailprice AS y FROM part), {TWO} SELECT unnest(['intercept', 'x1', 'x2']) AS factor, round(unnest([b0, bx, bz]), 3) AS coefficient FROM f")
def polynomial_fit(t: Tables):
    x = (F.col("p_size") - 25.0) / 25
    rows = t.part.select("p_retailprice", *[F.pow(x, F.lit(float(d))).alias(f"x{d}") for d in (1, 2)])
    return S.regression_table(rows, "p_retailprice", ["x1", "x2"]).select("factor", rounded(F.col("coefficient"), 3).alias("coefficient"))


@query("influence_of_two", f"WITH r AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS z, p_retailprice AS y FROM part), {TWO}, l AS (SELECT p_partkey, n, sse / (n - 3) AS s2, 1 / n + (zz * pow(x - mx, 2) - 2 * xz * (x - mx) * (z - mz) + xx * pow(z - mz, 2)) / (xx * zz - xz * xz) / n AS h, y - b0 - bx * x - bz * z AS e FROM r, f) SELECT p_partkey, round(h, 8) AS leverage, round(e / sqrt(s2 * (1 - h)), 5) AS residual, round(pow(e, 2) / (s2 * (1 - h)) / 3 * h / (1 - h), 7) AS cooks_distance FROM l")
def influence_of_two(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("z"), "p_retailprice")
    found = S.influence_of_many(rows, "p_retailprice", ["x", "z"])
    return found.select("p_partkey", rounded(F.col("leverage"), 8).alias("leverage"), rounded(F.col("residual"), 5).alias("residual"), rounded(F.col("cooks_distance"), 7).alias("cooks_distance"))


@query("stored_counts_best", "WITH g AS (SELECT quality AS y, n_chars AS c FROM labels JOIN documents USING (doc_id)), s AS (SELECT th, count(*) FILTER (WHERE y = 1 AND c > th)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND c > th)::DOUBLE AS fp, count(*) FILTER (WHERE y = 1 AND c <= th)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND c <= th)::DOUBLE AS tn FROM g, (SELECT unnest([100, 300, 1000, 3000]) AS th) GROUP BY 1), m AS (SELECT *, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM s) SELECT CAST(th AS INTEGER) AS threshold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * p * r / (p + r + 1e-9), 6) AS f1 FROM m ORDER BY f1 DESC, threshold LIMIT 1")
def stored_counts_best(t: Tables):
    graded = t.labels.join(t.documents, "doc_id").select("quality", "n_chars")
    y, c = F.col("quality"), F.col("n_chars")
    stored = reduce(lambda a, b: a.union(b), [graded.agg(F.lit(th).alias("threshold"), *[F.count_if(e).cast("double").alias(k) for k, e in (("tp", (y == 1) & (c > th)), ("fp", (y == 0) & (c > th)), ("fn", (y == 1) & (c <= th)), ("tn", (y == 0) & (c <= th)))]) for th in (100, 300, 1000, 3000)])
    best = S.stored_metrics(stored, "tp", "fp", "fn", "tn").orderBy(F.desc("f1"), "threshold").limit(1)
    return best.select("threshold", rounded(F.col("accuracy")).alias("accuracy"), rounded(F.col("f1")).alias("f1"))


@query("cross_validated_line", "WITH r AS (SELECT p_partkey % 5 AS fold, p_size::DOUBLE AS x, p_retailprice AS y FROM part), f AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r, (SELECT unnest(range(0, 5)) AS k) WHERE fold <> k GROUP BY 1) SELECT fold, round(avg(abs(y - a - b * x)), 5) AS mae FROM r JOIN f ON fold = k GROUP BY 1")
def cross_validated_line(t: Tables):
    rows = t.part.select((F.col("p_partkey") % 5).alias("fold"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return S.cross_validated(rows, "y", "x", "fold").withColumn("mae", rounded(F.col("mae"), 5))


DAYS = "d AS (SELECT row_number() OVER (ORDER BY d) - 1 AS t, d, n, count(*) OVER () AS m FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1))"
SPECTRUM = f"{DAYS}, s AS (SELECT CAST(k AS INTEGER) AS k, sqrt(pow(sum(n * cos(2 * pi() * k * t / m)), 2) + pow(sum(n * sin(2 * pi() * k * t / m)), 2)) AS a FROM d, (SELECT unnest(range(0, (SELECT max(m) FROM d) // 2 + 1)) AS k) GROUP BY 1)"


def daily(t: Tables):
    return t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))


@query("spectrum_peaks", f"WITH {SPECTRUM}, p AS (SELECT k, a, lag(a) OVER (ORDER BY k) AS l, lead(a) OVER (ORDER BY k) AS r FROM s) SELECT k, round(a, 4) AS amplitude FROM p WHERE a >= 1 AND a > coalesce(l, -1) AND a > coalesce(r, -1) ORDER BY a DESC, k LIMIT 5")
def spectrum_peaks(t: Tables):
    return S.peaks(S.spectrum(daily(t), "d", "n"), 5, 1.0).withColumn("amplitude", rounded(F.col("amplitude"), 4))


@query("notched_series", f"WITH {DAYS}, c AS (SELECT 2 * avg(n * cos(2 * pi() * 3 * t / m)) AS a, 2 * avg(n * sin(2 * pi() * 3 * t / m)) AS b FROM d) SELECT CAST(d AS VARCHAR) AS d, round(n - a * cos(2 * pi() * 3 * t / m) - b * sin(2 * pi() * 3 * t / m), 5) AS filtered FROM d, c")
def notched_series(t: Tables):
    return S.notched(daily(t), "d", "n", 3).select(F.col("d").cast("string").alias("d"), rounded(F.col("filtered"), 5).alias("filtered"))


@query("harmonic_product", f"WITH {SPECTRUM} SELECT x.k, round(x.a * y.a * z.a, 2) AS product FROM s x JOIN s y ON y.k = 2 * x.k JOIN s z ON z.k = 3 * x.k WHERE x.k > 0")
def harmonic_product(t: Tables):
    return S.harmonic_product(S.spectrum(daily(t), "d", "n"), 3).withColumn("product", rounded(F.col("product"), 2))


@query("frame_vote", "WITH f AS (SELECT date_trunc('hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT w, event_type FROM f QUALIFY row_number() OVER (PARTITION BY w ORDER BY n DESC, event_type) = 1) SELECT event_type, count(*) AS frames FROM b GROUP BY 1")
def frame_vote(t: Tables):
    frames = t.events.groupBy(F.date_trunc("hour", "ts").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    won = frames.groupBy("w").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("event_type"))
    return won.groupBy("event_type").agg(F.count(F.lit(1)).alias("frames"))
