"""Queries of fitted models; SQL can't express them, so tests check their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import models as L
from quarry.plans.analytics import BASKETS
from quarry.plans.registry import Tables, query, rounded


def graded(t: Tables):
    return t.labels.join(t.documents, "doc_id").select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", r"[\w\s]", "")).cast("double").alias("marks"))


@query("model_classify")
def model_classify(t: Tables):
    rows = graded(t)
    return L.classify(rows.where("crc32(cast(doc_id as string)) % 5 != 0"), rows, ["n_chars", "marks"], "quality", "tree").select("doc_id", "quality", "prediction")


@query("model_bayes")
def model_bayes(t: Tables):
    rows = graded(t)
    return L.classify(rows, rows, ["n_chars", "marks"], "quality", "gaussian").select("doc_id", "quality", "prediction")


@query("model_regress")
def model_regress(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    return L.regress(rows, rows, ["l_quantity", "l_discount"], "l_extendedprice").select("l_orderkey", "l_linenumber", rounded(F.col("prediction"), 2).alias("prediction"))


@query("model_coefficients")
def model_coefficients(t: Tables):
    return L.coefficient_tests(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@query("model_clusters")
def model_clusters(t: Tables):
    return L.clusters(L.from_arrays(t.embeddings, "embedding"), 10).select("vec_id", "cluster")


@query("model_silhouettes")
def model_silhouettes(t: Tables):
    return L.silhouettes(L.from_arrays(t.embeddings, "embedding"), [2, 4, 8])


@query("model_components")
def model_components(t: Tables):
    return L.principal_components(L.from_arrays(t.embeddings, "embedding"), 2).select("vec_id", "components")


@query("model_frequent_patterns", f"WITH b AS {BASKETS}, n AS (SELECT count(DISTINCT basket) AS total FROM b) SELECT item AS items, count(*) AS freq FROM b, n GROUP BY 1 HAVING count(*) >= 0.02 * max(total) UNION ALL SELECT x.item || ',' || y.item, count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item, n GROUP BY 1 HAVING count(*) >= 0.02 * max(total) UNION ALL SELECT x.item || ',' || y.item || ',' || z.item, count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = y.basket AND y.item < z.item, n GROUP BY 1 HAVING count(*) >= 0.02 * max(total)")
def model_frequent_patterns(t: Tables):
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))
    return L.frequent_patterns(items, 0.02).select(F.array_join(F.sort_array("items"), ",").alias("items"), "freq")


#: The most documents that the language model is fitted on, those with the smallest hashes of their ids; all are predicted.
MAX_FITTED = 20_000


@query("model_language")
def model_language(t: Tables):
    docs = t.documents.select("doc_id", "text", "lang")
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FITTED)
    return L.identify_language(docs.join(F.broadcast(chosen.distinct()), "doc_id"), docs, features=1000).select("doc_id", "lang", "predicted")


@query("density_clusters")
def density_clusters(t: Tables):
    points = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("x"), (F.col("p_size") / 5).alias("y"))
    return L.density_clusters(points, 0.5, 4)


@query("model_accuracies")
def model_accuracies(t: Tables):
    rows = graded(t)
    return L.accuracies(rows.where("crc32(cast(doc_id as string)) % 5 != 0"), rows, ["n_chars", "marks"], "quality", ["logistic", "tree", "forest", "boosted", "svm"])


@query("model_boosted_regression")
def model_boosted_regression(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 1000).cast("double").alias("rest"), "p_retailprice")
    return L.regress(rows, rows, ["size", "rest"], "p_retailprice", "boosted", maxIter=10).select("p_partkey", rounded(F.col("prediction"), 2).alias("prediction"))


@query("model_text_report")
def model_text_report(t: Tables):
    docs = t.documents.select("doc_id", "text", "lang")
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FITTED)
    return L.classification_report(L.identify_text(docs.join(F.broadcast(chosen.distinct()), "doc_id"), docs, "text", "lang"), "lang", "predicted")


@query("model_mixture")
def model_mixture(t: Tables):
    rows = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), (F.col("p_retailprice") / 100).alias("price"))
    return L.clusters(L.assembled(rows, ["size", "price"]), 3, "mixture").select("p_partkey", "cluster")


@query("density_clusters_3d")
def density_clusters_3d(t: Tables):
    points = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("x"), (F.col("p_size") / 5).alias("y"), (F.col("p_partkey") % 3).cast("double").alias("z"))
    return L.density_clusters(points, 0.8, 4, more=["z"])
