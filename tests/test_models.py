"""Properties of queries and operators that SQL can't check."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import mining, models, stats
from quarry.plans import QUERIES
from quarry.sources.tables import load

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


def majority(values):
    return max(Counter(values).values()) / len(values)


@pytest.mark.parametrize("name, actual, predicted", [("model_classify", "quality", "prediction"), ("model_bayes", "quality", "prediction"), ("model_language", "lang", "predicted")])
def test_classifiers_beat_the_majority(spark, name, actual, predicted):
    rows = rows_of(spark, name)
    assert np.mean([r[actual] == r[predicted] for r in rows]) >= majority([r[actual] for r in rows])


def test_accuracies(spark):
    rows = {r.how: r.accuracy for r in rows_of(spark, "model_accuracies")}
    assert rows.keys() == {"logistic", "tree", "forest", "boosted", "svm"} and min(rows.values()) > 0.5


def test_coefficients_solve_the_normal_equations(spark):
    lines = load(spark, SF, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice").collect()
    a = np.array([[1.0, r[0], r[1], r[2]] for r in lines])
    b, *_ = np.linalg.lstsq(a, np.array([r[3] for r in lines]), rcond=None)
    got = {r.factor: r.coefficient for r in rows_of(spark, "model_coefficients")}
    assert [got[k] for k in ("intercept", "l_quantity", "l_discount", "l_tax")] == pytest.approx(b.tolist(), rel=1e-6)


def test_many_factors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(size=200) / 10
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, d double, y double")
    table = {r.factor: r for r in stats.regression_table(df, "y", ["a", "b", "c", "d"]).collect()}
    model = {r.factor: r for r in models.coefficient_tests(df, ["a", "b", "c", "d"], "y").collect()}
    for k, r in table.items():
        assert (r.coefficient, r.t) == pytest.approx((model[k].coefficient, model[k].t), rel=1e-6)
    design = np.column_stack([np.ones(200), x])
    hat = np.diag(design @ np.linalg.inv(design.T @ design) @ design.T)
    got = stats.influence_of_many(df, "y", ["a", "b", "c", "d"]).orderBy("y").collect()
    assert [r.leverage for r in got] == pytest.approx(hat[np.argsort(y)].tolist())


def test_regressions_lower_the_error(spark):
    prices = [r.p_retailprice for r in load(spark, SF, "part").orderBy("p_partkey").collect()]
    got = [r.prediction for r in sorted(rows_of(spark, "model_boosted_regression"), key=lambda r: r.p_partkey)]
    assert np.abs(np.array(prices) - got).mean() < np.abs(np.array(prices) - np.mean(prices)).mean()
    lines = load(spark, SF, "lineitem").orderBy("l_orderkey", "l_linenumber").collect()
    line = sorted(rows_of(spark, "model_regress"), key=lambda r: (r.l_orderkey, r.l_linenumber))
    y = np.array([r.l_extendedprice for r in lines])
    assert ((y - [r.prediction for r in line]) ** 2).sum() <= ((y - y.mean()) ** 2).sum()


def test_clusters_and_silhouettes(spark):
    points = [(k, float(10 * (k % 3)) + (k % 7) / 10, float(k % 2) / 5) for k in range(90)]
    df = models.assembled(spark.createDataFrame(points, "id long, x double, y double"), ["x", "y"])
    for how in ("kmeans", "bisecting", "mixture"):
        groups = defaultdict(set)
        for r in models.clusters(df, 3, how).collect():
            groups[r.cluster].add(r.id % 3)
        assert sorted(map(len, groups.values())) == [1, 1, 1], how
    scores = {r.k: r.silhouette for r in models.silhouettes(df, [2, 3, 5]).collect()}
    assert max(scores, key=scores.get) == 3
    assert {r.cluster for r in rows_of(spark, "model_clusters")} <= set(range(10)) and len(rows_of(spark, "model_silhouettes")) == 3
    assert len({r.cluster for r in rows_of(spark, "model_mixture")}) > 1


def test_components_are_uncorrelated(spark):
    c = np.array([r.components for r in rows_of(spark, "model_components")])
    assert c.shape[1] == 2 and abs(np.corrcoef(c.T)[0, 1]) < 1e-6 and c[:, 0].var() >= c[:, 1].var()


def by_hand(points, eps, least):
    near = {a: [b for b in points if math.dist(points[a], points[b]) <= eps] for a in points}
    core = {a for a in points if len(near[a]) >= least}
    label = {}
    for a in sorted(core):
        stack = [a] if a not in label else []
        while stack:
            b = stack.pop()
            if b in core and b not in label:
                label[b] = a
                stack += near[b]
    return {a: label.get(a, min((label[b] for b in near[a] if b in core), default=None)) for a in points}


@pytest.mark.parametrize("more", [[], ["z"]])
def test_density_clusters_by_hand(spark, more):
    rng = np.random.default_rng(5)
    rows = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 6, (150, 3)))]
    got = {r.id: r.cluster for r in models.density_clusters(spark.createDataFrame(rows, "id long, x double, y double, z double"), 0.9, 4, more=more).collect()}
    assert got == by_hand({r[0]: r[1 : 3 + len(more)] for r in rows}, 0.9, 4)


def test_density_queries(spark):
    for name in ("density_clusters", "density_clusters_3d"):
        sizes = Counter(r.cluster for r in rows_of(spark, name))
        assert all(k is None or n >= 2 for k, n in sizes.items())


def test_patterns_equal_itemsets(spark):
    baskets = spark.createDataFrame([(b, x) for b in range(40) for x in "abcdef" if (b * ord(x)) % 7 < 4], "basket int, item string")
    levels = {tuple(r["items"]): r.n for r in mining.frequent_itemsets(baskets, 0.3).collect()}
    grouped = baskets.groupBy("basket").agg(F.collect_set("item").alias("items"))
    assert {tuple(sorted(r["items"])): r.freq for r in models.frequent_patterns(grouped, 0.3).collect()} == levels


def test_huffman_is_a_complete_prefix_code(spark):
    rows = rows_of(spark, "huffman_size")
    assert sum(2.0 ** -len(r.code) for r in rows) == 1.0
    codes = sorted(r.code for r in rows)
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
    (total,) = rows_of(spark, "huffman_totals")
    n = sum(r.n for r in rows)
    entropy = -sum(r.n / n * math.log2(r.n / n) for r in rows)
    assert total.characters == n and entropy * n <= total.bits < (entropy + 1) * n and total.bits <= total.fixed_bits


def test_text_report(spark):
    rows = rows_of(spark, "model_text_report")
    docs = load(spark, SF, "documents")
    assert sum(r.support for r in rows) == docs.count() and all(0 <= r.f1 <= 1 for r in rows)
    assert max(r.f1 for r in rows) > 0.8


def test_kernel_outranks_the_rest(spark):
    assert 1 <= len(rows_of(spark, "outranking_kernel")) <= 5


def test_digests(spark):
    for r in rows_of(spark, "hash_digests"):
        for name, digest in (("sha1", hashlib.sha1), ("sha512", hashlib.sha512), ("sha3", hashlib.sha3_256)):
            assert r[name] == digest(r.n_name.encode()).hexdigest()
