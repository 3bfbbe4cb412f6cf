"""Statistics and model evaluation from grouped counts and sums."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.frame import average_rank

EPSILON = 1e-9


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """accuracy, macro precision, recall, specificity, f1, g_mean, balanced_accuracy, and micro averages: one row, from the confusion counts."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    hit = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0.0))
    per = cells.withColumn("c", F.explode(F.array_distinct(F.array("a", "p")))).groupBy("c").agg(
        hit((F.col("a") == F.col("c")) & (F.col("p") == F.col("c"))).alias("tp"), hit((F.col("a") != F.col("c")) & (F.col("p") == F.col("c"))).alias("fp"), hit((F.col("a") == F.col("c")) & (F.col("p") != F.col("c"))).alias("fn")
    ).crossJoin(F.broadcast(total))  # one row for each class
    per = per.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON), F.col("tp") / (F.col("tp") + F.col("fn") + EPSILON)
    specificity = F.col("tn") / (F.col("tn") + F.col("fp") + EPSILON)
    return per.agg(
        (F.sum("tp") / F.max("total")).alias("accuracy"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(specificity).alias("specificity"),
        F.avg(2 * precision * recall / (precision + recall + EPSILON)).alias("f1"), F.exp(F.avg(F.log(F.greatest(recall, F.lit(EPSILON))))).alias("g_mean"), F.avg((recall + specificity) / 2).alias("balanced_accuracy"),
        (F.sum("tp") / (F.sum("tp") + F.sum("fp") + EPSILON)).alias("micro_precision"), (F.sum("tp") / (F.sum("tp") + F.sum("fn") + EPSILON)).alias("micro_recall"), (2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn") + EPSILON)).alias("micro_f1"),
    )


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def two_factor_regression(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares on two factors by the normal equations, solved in columns: b0, b1, b2, r2."""
    cov = {(a, b): F.covar_pop(a, b) for a in (x1, x2, y) for b in (x1, x2, y)}
    one = df.agg(*[e.alias(f"{a}|{b}") for (a, b), e in cov.items()], *[F.avg(c).alias(f"m|{c}") for c in (x1, x2, y)])
    c = lambda a, b: F.col(f"`{a}|{b}`")
    det = c(x1, x1) * c(x2, x2) - c(x1, x2) * c(x1, x2)
    b1 = (c(x1, y) * c(x2, x2) - c(x2, y) * c(x1, x2)) / det
    b2 = (c(x2, y) * c(x1, x1) - c(x1, y) * c(x1, x2)) / det
    m = lambda a: F.col(f"`m|{a}`")
    return one.select((m(y) - b1 * m(x1) - b2 * m(x2)).alias("b0"), b1.alias("b1"), b2.alias("b2"), ((b1 * c(x1, y) + b2 * c(x2, y)) / c(y, y)).alias("r2"))


def influence(df: DataFrame, y: str, x: str) -> DataFrame:
    """leverage, standardised residual, Cook's distance and DFFITS of each row of a one-factor regression."""
    fit = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.var_pop(x) * F.count(F.lit(1))).alias("_sxx"), (F.covar_pop(x, y) * F.count(F.lit(1))).alias("_sxy"), (F.var_pop(y) * F.count(F.lit(1))).alias("_syy"))
    rows = df.crossJoin(F.broadcast(fit))
    slope = F.col("_sxy") / F.col("_sxx")
    s2 = (F.col("_syy") - slope * F.col("_sxy")) / (F.col("_n") - 2)
    h = 1 / F.col("_n") + F.pow(F.col(x) - F.col("_mx"), 2) / F.col("_sxx")
    e = F.col(y) - F.col("_my") - slope * (F.col(x) - F.col("_mx"))
    out = rows.withColumns({"leverage": h, "_e": e, "_s2": s2}).withColumn("residual", F.col("_e") / F.sqrt(F.col("_s2") * (1 - F.col("leverage"))))
    s2_without = ((F.col("_n") - 2) * F.col("_s2") - F.pow("_e", F.lit(2)) / (1 - F.col("leverage"))) / (F.col("_n") - 3)
    t = F.col("_e") / F.sqrt(s2_without * (1 - F.col("leverage")))
    out = out.withColumns({"cooks_distance": F.pow("residual", F.lit(2)) / 2 * F.col("leverage") / (1 - F.col("leverage")), "dffits": t * F.sqrt(F.col("leverage") / (1 - F.col("leverage")))})
    return out.drop("_n", "_mx", "_my", "_sxx", "_sxy", "_syy", "_e", "_s2")


def pooled_t(df: DataFrame, value: str, is_first: Column) -> DataFrame:
    """Two-sample t with pooled variance: t and degrees of freedom, one row."""
    a, b = F.when(is_first, F.col(value)), F.when(~is_first, F.col(value))
    one = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2)
    return one.select(((F.col("ma") - F.col("mb")) / F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb")))).alias("t"), (F.col("na") + F.col("nb") - 2).cast("long").alias("degrees"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F and degrees of freedom, one row."""
    per = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = per.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("between"))
    return one.select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).cast("long").alias("df_between"), (F.col("n") - F.col("k")).cast("long").alias("df_within"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) on ranks with ties at their mean: one row."""
    ranked = average_rank(average_rank(df.select(a, b), a, "_ra"), b, "_rb")
    n = F.count(F.lit(1)).cast("double")
    return ranked.agg((1 - 6 * F.sum(F.pow(F.col("_ra") - F.col("_rb"), 2)) / (n * (n * n - 1))).alias("rho"))


def regression_errors(df: DataFrame, y: str, predicted: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(predicted))).alias("mae"), F.avg(F.pow(F.col(y) - F.col(predicted), 2)).alias("mse"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean: one row."""
    ranked = average_rank(df.select(label, score), score, "_r")
    pos, n = F.sum(F.col(label).cast("double")), F.count(F.lit(1))
    return ranked.agg(((F.sum(F.when(F.col(label) == 1, F.col("_r"))) - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("auc"))


def spectrum(series: DataFrame, order: str, value: str) -> DataFrame:
    """Discrete Fourier amplitudes of all frequencies of a short series (one row a point): k from 0 to half the points, amplitude.

    The series is an aggregate (a point a day, say); each point meets each frequency once.
    """
    points = series.select((F.row_number().over(W.orderBy(order)) - 1).alias("t"), F.col(value).cast("double").alias("y"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    waves = points.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / 2))))
    angle = 2 * math.pi * F.col("k") * F.col("t") / F.col("n")
    return waves.groupBy(F.col("k").cast("int").alias("k")).agg(F.sqrt(F.pow(F.sum(F.col("y") * F.cos(angle)), 2) + F.pow(F.sum(F.col("y") * F.sin(angle)), 2)).alias("amplitude"))


def roll_up_tree(rooms: DataFrame, building: str, floor: str, area: str, volume: str, light: str, energy: str) -> DataFrame:
    """Rooms to floors to buildings: areas and volumes add up; a floor's light is by area and its energy by volume; a building's are the plain means of its floors'."""
    floors = rooms.groupBy(building, floor).agg(F.sum(area).alias("area"), F.sum(volume).alias("volume"), (F.sum(light) / F.sum(area)).alias("light"), (F.sum(energy) / F.sum(volume)).alias("energy"))
    return floors.groupBy(building).agg(F.sum("area").alias("area"), F.sum("volume").alias("volume"), F.avg("light").alias("light"), F.avg("energy").alias("energy"))


def least_squares(df: DataFrame, y: str, xs: list[str]) -> tuple[list[float], np.ndarray, dict[str, float]]:
    """Coefficients (intercept first), the inverse of X'X, and n, sse, ssr and sst, from one aggregation of cross products."""
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    k = len(terms)
    row = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*xs, y]])).agg(*[F.coalesce(F.sum(terms[i] * terms[j]), F.lit(0.0)).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    s = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.inv(s[:-1, :-1])
    b = inverse @ s[:-1, -1]
    sst = s[-1, -1] - s[0, -1] ** 2 / s[0, 0]
    sse = max(0.0, s[-1, -1] - float(b @ s[:-1, -1]))
    return b.tolist(), inverse, {"n": float(s[0, 0]), "sse": sse, "ssr": float(sst - sse), "sst": float(sst)}


def regression_table(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """factor, coefficient, t, and the whole fit's r2, f, sse and ssr: a row for the intercept and each factor."""
    b, inverse, fit = least_squares(df, y, xs)
    free = fit["n"] - len(b)
    s2 = fit["sse"] / free
    f = fit["ssr"] / len(xs) / s2
    rows = [(name, b[k], b[k] / math.sqrt(s2 * inverse[k, k]), fit["ssr"] / fit["sst"], f, fit["sse"], fit["ssr"]) for k, name in enumerate(["intercept", *xs])]
    return df.sparkSession.createDataFrame([tuple(map(lambda v: float(v) if not isinstance(v, str) else v, r)) for r in rows], "factor string, coefficient double, t double, r2 double, f double, sse double, ssr double")


def influence_of_many(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """leverage, standardised residual, Cook's distance and DFFITS of each row of a regression on any number of factors."""
    b, inverse, fit = least_squares(df, y, xs)
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    p, s2 = len(b), fit["sse"] / (fit["n"] - len(b))
    h = reduce(lambda u, v: u + v, [terms[i] * terms[j] * float(inverse[i, j]) for i in range(p) for j in range(p)])
    e = F.col(y) - reduce(lambda u, v: u + v, [t * float(c) for t, c in zip(terms, b, strict=True)])
    out = df.withColumns({"leverage": h, "_e": e}).withColumn("residual", F.col("_e") / F.sqrt(s2 * (1 - F.col("leverage"))))
    without = ((fit["n"] - p) * s2 - F.pow("_e", F.lit(2)) / (1 - F.col("leverage"))) / (fit["n"] - p - 1)
    t = F.col("_e") / F.sqrt(without * (1 - F.col("leverage")))
    return out.withColumns({"cooks_distance": F.pow("residual", F.lit(2)) / p * F.col("leverage") / (1 - F.col("leverage")), "dffits": t * F.sqrt(F.col("leverage") / (1 - F.col("leverage")))}).drop("_e")


def stored_metrics(df: DataFrame, tp: str, fp: str, fn: str, tn: str) -> DataFrame:
    """``df`` with accuracy, precision, recall, specificity and f1 from its columns of counts."""
    precision, recall = F.col(tp) / (F.col(tp) + F.col(fp) + EPSILON), F.col(tp) / (F.col(tp) + F.col(fn) + EPSILON)
    return df.withColumns({
        "accuracy": (F.col(tp) + F.col(tn)) / (F.col(tp) + F.col(fp) + F.col(fn) + F.col(tn)), "precision": precision, "recall": recall,
        "specificity": F.col(tn) / (F.col(tn) + F.col(fp) + EPSILON), "f1": 2 * precision * recall / (precision + recall + EPSILON),
    })


def cross_validated(df: DataFrame, y: str, x: str, fold: str) -> DataFrame:
    """fold and mae: for each fold the error of the line that all other folds' sums give."""
    sums = {"n": F.count(F.lit(1)), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(F.col(x) * F.col(x)), "xy": F.sum(F.col(x) * F.col(y))}
    per = df.groupBy(F.col(fold).alias("_f")).agg(*[e.cast("double").alias(f"_{k}") for k, e in sums.items()])  # a row for each fold
    total = per.agg(*[F.sum(f"_{k}").alias(f"_t{k}") for k in sums])
    rest = per.crossJoin(F.broadcast(total)).select("_f", *[(F.col(f"_t{k}") - F.col(f"_{k}")).alias(f"_{k}") for k in sums])
    slope = (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / (F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x"))
    lines = rest.select("_f", slope.alias("_b"), ((F.col("_y") - slope * F.col("_x")) / F.col("_n")).alias("_a"))
    return df.join(F.broadcast(lines), F.col(fold) == F.col("_f")).groupBy(fold).agg(F.avg(F.abs(F.col(y) - F.col("_a") - F.col("_b") * F.col(x))).alias("mae"))


def peaks(amplitudes: DataFrame, n: int, least: float = 0.0, k: str = "k", amplitude: str = "amplitude") -> DataFrame:
    """The ``n`` greatest local maxima of a spectrum (a row a frequency) of at least ``least``."""
    w = W.orderBy(k)
    tops = amplitudes.withColumns({"_l": F.lag(amplitude).over(w), "_r": F.lead(amplitude).over(w)}).where((F.col(amplitude) >= least) & (F.col(amplitude) > F.coalesce("_l", F.lit(-1.0))) & (F.col(amplitude) > F.coalesce("_r", F.lit(-1.0))))
    return tops.drop("_l", "_r").orderBy(F.desc(amplitude), k).limit(n)


def notched(series: DataFrame, order: str, value: str, k: int) -> DataFrame:
    """A short series without its frequency ``k`` (0 < k < half the points): order, value, filtered."""
    points = series.select(order, F.col(value).cast("double").alias(value), (F.row_number().over(W.orderBy(order)) - 1).alias("_t"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))
    angle = 2 * math.pi * k * F.col("_t") / F.col("_n")
    parts = points.agg((2 * F.avg(F.col(value) * F.cos(angle))).alias("_a"), (2 * F.avg(F.col(value) * F.sin(angle))).alias("_b"))
    return points.crossJoin(F.broadcast(parts)).select(order, value, (F.col(value) - F.col("_a") * F.cos(angle) - F.col("_b") * F.sin(angle)).alias("filtered"))  # one row


def harmonic_product(amplitudes: DataFrame, harmonics: int, k: str = "k", amplitude: str = "amplitude") -> DataFrame:
    """k and product: amplitudes at k, 2 k and so on multiplied, where all are in the spectrum; k from 1."""
    out = amplitudes.where(F.col(k) > 0).select(k, F.col(amplitude).alias("product"))
    for h in range(2, harmonics + 1):
        higher = amplitudes.where(F.col(k) % h == 0).select((F.col(k) / h).cast("int").alias(k), F.col(amplitude).alias("_a"))
        out = out.join(higher, k).select(k, (F.col("product") * F.col("_a")).alias("product"))
    return out
