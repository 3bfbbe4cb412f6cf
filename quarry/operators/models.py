"""Fitted models of ``pyspark.ml`` behind functions from DataFrame to DataFrame, and clusters by density."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, StringIndexer, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import char_ngrams, tokens_without
from quarry.session import cut_lineage

CLASSIFIERS = {
    "logistic": LogisticRegression, "tree": lambda **k: DecisionTreeClassifier(impurity="entropy", **k), "forest": lambda **k: RandomForestClassifier(seed=1, **k),
    "boosted": lambda **k: GBTClassifier(seed=1, **k), "svm": LinearSVC, "bernoulli": lambda **k: NaiveBayes(modelType="bernoulli", **k), "gaussian": lambda **k: NaiveBayes(modelType="gaussian", **k),
}


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def from_arrays(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def classify(train: DataFrame, rows: DataFrame, columns: list[str], label: str, how: str, **options) -> DataFrame:
    """``rows`` with a column prediction, of a model fitted on ``train``."""
    model = CLASSIFIERS[how](labelCol=label, featuresCol="features", **options).fit(assembled(train, columns))
    return model.transform(assembled(rows, columns)).drop("features", "rawPrediction", "probability")


def regress(train: DataFrame, rows: DataFrame, columns: list[str], label: str, how: str = "linear", **options) -> DataFrame:
    kind = LinearRegression(labelCol=label, **options) if how == "linear" else GBTRegressor(labelCol=label, seed=1, **options)
    return kind.fit(assembled(train, columns)).transform(assembled(rows, columns)).drop("features")


def coefficient_tests(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Coefficient, t and p of each factor and the intercept of a linear regression."""
    model = LinearRegression(labelCol=label, solver="normal").fit(assembled(df, columns))
    s = model.summary
    names = [*columns, "intercept"]
    values = zip(names, [*map(float, model.coefficients), float(model.intercept)], map(float, s.tValues), map(float, s.pValues), strict=True)
    return df.sparkSession.createDataFrame(list(values), "factor string, coefficient double, t double, p double")


def clusters(df: DataFrame, k: int, how: str = "kmeans", seed: int = 1) -> DataFrame:
    """``df``, which has features, with a column cluster."""
    kind = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}[how]
    return kind(k=k, seed=seed, predictionCol="cluster").fit(df).transform(df).drop("probability")


def silhouettes(df: DataFrame, ks: list[int], seed: int = 1) -> DataFrame:
    """k, cost and silhouette for each number of clusters; the elbow is where the second difference of cost is greatest."""
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(df)
        rows.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator(predictionCol="cluster").evaluate(model.transform(df)))))
    return df.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def principal_components(df: DataFrame, k: int) -> DataFrame:
    return PCA(k=k, inputCol="features", outputCol="_pca").fit(df).transform(df).withColumn("components", vector_to_array("_pca")).drop("_pca", "features")


def frequent_patterns(baskets: DataFrame, least: float, items: str = "items") -> DataFrame:
    return FPGrowth(itemsCol=items, minSupport=least).fit(baskets).freqItemsets


def identify_language(train: DataFrame, rows: DataFrame, text: str = "text", label: str = "lang", n: int = 3, features: int = 2000) -> DataFrame:
    """``rows`` with a column predicted: by counts of character n-grams and logistic regression."""
    grams = lambda df: df.withColumn("_grams", char_ngrams(F.lower(text), n))
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep")
    steps = Pipeline(stages=[index, CountVectorizer(inputCol="_grams", outputCol="features", vocabSize=features), LogisticRegression(labelCol="_label", featuresCol="features", maxIter=20)])
    model = steps.fit(grams(train))
    names = F.array(*[F.lit(x) for x in [*model.stages[0].labels, "unknown"]])
    return model.transform(grams(rows)).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).drop("_grams", "_label", "features", "rawPrediction", "probability", "prediction")


def density_clusters(points: DataFrame, eps: float, least: int, x: str = "x", y: str = "y", key: str = "id", more: list[str] = ()) -> DataFrame:
    """DBSCAN of points in the plane, or with ``more`` columns in more dimensions: key and cluster (the least core key; null for noise).

    Equal points are one, with a weight. Cells are so small that all points of one are neighbours: where a cell has
    ``least`` points all are core, and only points of other cells, fewer than ``least`` in each, are compared with the
    cells around, so no crowded place is paired with itself. Cells of core points are joined by their outermost points;
    all core points of two cells are compared only where those leave the cells in different components. Components are
    least cells, and the labels of those, until none changes. Points with a coordinate that is no finite number are noise.
    """
    axes = [x, y, *more]
    side = eps / len(axes) ** 0.5 * (1 - 1e-6)
    reach = int(eps / side) + 1
    at = [f"_{i}" for i in range(len(axes))]
    finite = reduce(lambda p, q: p & q, [F.abs(F.col(c).cast("double")) < float("inf") for c in axes])
    named = points.select(key, *[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(axes, at, strict=True)], finite.alias("_finite"))
    cell = F.array(*[F.floor(F.col(n) / side) for n in at])
    each = cut_lineage(named.where("_finite").groupBy(*at).agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("k")).withColumn("cell", cell))
    cells = each.groupBy("cell").agg(F.sum("w").alias("held"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    offsets = reduce(lambda p, _: F.flatten(F.transform(p, lambda o: F.transform(steps, lambda d: F.concat(o, F.array(d))))), axes, F.array(F.array().cast("array<int>")))
    moved = cells.select(F.col("cell").alias("c"), "held", F.explode(offsets).alias("o")).select("c", "held", F.zip_with("c", "o", lambda p, q: p + q).alias("cell"))
    around = cut_lineage(moved.join(cells.select("cell"), "cell"))  # pairs of cells that have points
    apart = lambda p, q: reduce(lambda u, v: u + v, [(F.col(f"{p}{n}") - F.col(f"{q}{n}")) * (F.col(f"{p}{n}") - F.col(f"{q}{n}")) for n in at])
    prefixed = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    few = prefixed(each, "a").join(around.where(F.col("held") < least).select(F.col("c").alias("acell"), F.col("cell").alias("bcell")), "acell")
    near = cut_lineage(few.join(prefixed(each, "b"), "bcell").where(apart("a", "b") <= eps * eps).select(*[f"a{n}" for n in at], *[f"b{n}" for n in at], "bw", "bcell"))
    same = [f"a{n}" for n in at]
    lone = near.groupBy(*same).agg(F.sum("bw").alias("n")).where(F.col("n") >= least).select(*[F.col(f"a{n}").alias(n) for n in at])
    crowded = each.join(cells.where(F.col("held") >= least), "cell").select(*each.columns)
    core = cut_lineage(crowded.union(each.join(lone, at).select(*each.columns)))

    ends = [f(F.struct(F.col(n), *[m for m in at if m != n])).alias(f"{w}{n}") for n in at for w, f in (("l", F.min), ("h", F.max))]
    outer = core.groupBy("cell").agg(*ends)
    outer = outer.select("cell", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"{w}{n}")[m].alias(m) for m in at]) for n in at for w in "lh"]))).alias("e")).select("cell", "e.*")
    beside = around.select(F.col("c").alias("acell"), F.col("cell").alias("bcell"))

    def linked(points_a: DataFrame, pairs: DataFrame) -> DataFrame:
        p = points_a.select("cell", *at)
        return cut_lineage(prefixed(p, "a").join(pairs, "acell").join(prefixed(p, "b"), "bcell").where(apart("a", "b") <= eps * eps).select("acell", "bcell").distinct())

    edges = linked(outer, beside)
    labels = _cell_components(edges)
    far = beside.where("acell < bcell").join(labels.toDF("acell", "la"), "acell").join(labels.toDF("bcell", "lb"), "bcell").where("la != lb").select("acell", "bcell")
    more_edges = linked(core, far)
    if not more_edges.isEmpty():
        labels = _cell_components(edges.union(more_edges).union(more_edges.select(F.col("bcell"), F.col("acell"))))
    inside = cut_lineage(core.join(labels, "cell"))
    clusters_ = inside.groupBy("label").agg(F.min("k").alias("cluster"))
    own = cut_lineage(inside.join(clusters_, "label").select(*at, "cluster"))
    border = near.join(prefixed(own, "b"), [f"b{n}" for n in at]).groupBy(*same).agg(F.min("bcluster").alias("near_cluster")).select(*[F.col(f"a{n}").alias(n) for n in at], "near_cluster")
    return named.join(own, at, "left").join(border, at, "left").select(key, F.coalesce("cluster", "near_cluster").alias("cluster"))


def _cell_components(edges: DataFrame) -> DataFrame:
    """cell and label, the least cell of its component, of ``edges`` (acell, bcell: both ways, and each cell with itself)."""
    labels = cut_lineage(edges.groupBy(F.col("acell").alias("cell")).agg(F.min("bcell").alias("label")))
    while True:
        least_near = edges.join(labels.toDF("bcell", "label"), "bcell").groupBy(F.col("acell").alias("cell")).agg(F.min("label").alias("m"))
        merged = cut_lineage(labels.join(least_near, "cell").select("cell", F.least("label", "m").alias("label"), F.col("label").alias("old")))
        jumped = cut_lineage(merged.join(merged.select(F.col("cell").alias("label"), F.col("label").alias("far")), "label").select("cell", F.least("label", "far").alias("label"), "old"))
        labels = jumped.select("cell", "label")
        if jumped.where("label != old").isEmpty():
            return labels


def identify_text(train: DataFrame, rows: DataFrame, text: str, label: str, how: str = "bayes", features: int = 1000, max_df: float = 1.0, stop_words: list[str] = ()) -> DataFrame:
    """``rows`` with a column predicted: tf-idf of the ``features`` most frequent words, then Bayes, logistic regression or a linear SVC."""
    words = lambda df: df.withColumn("_words", tokens_without(list(stop_words))(F.col(text)))
    index = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="keep")
    kinds = {"bayes": NaiveBayes(labelCol="_label"), "logistic": LogisticRegression(labelCol="_label", maxIter=20), "svm": OneVsRest(classifier=LinearSVC(maxIter=20), labelCol="_label")}
    steps = [index, CountVectorizer(inputCol="_words", outputCol="_tf", vocabSize=features, maxDF=max_df), IDF(inputCol="_tf", outputCol="features"), kinds[how]]
    model = Pipeline(stages=steps).fit(words(train))
    names = F.array(*[F.lit(x) for x in [*model.stages[0].labels, "unknown"]])
    return model.transform(words(rows)).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).select(*rows.columns, "predicted")


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 and support of each class, from the confusion counts."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = cells.withColumn("label", F.explode(F.array_distinct(F.array("a", "p"))))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0.0))
    a, p = F.col("a") == F.col("label"), F.col("p") == F.col("label")
    per = each.groupBy("label").agg(part(a & p).alias("tp"), part(~a & p).alias("fp"), part(a).alias("support"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return per.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("support").cast("long").alias("support"))


def accuracies(train: DataFrame, rows: DataFrame, columns: list[str], label: str, hows: list[str]) -> DataFrame:
    """how and accuracy of several classifiers fitted on ``train``."""
    parts = [classify(train, rows, columns, label, how).agg(F.lit(how).alias("how"), F.avg((F.col("prediction") == F.col(label)).cast("int")).alias("accuracy")) for how in hows]
    return reduce(lambda a, b: a.unionByName(b), parts)
