"""Data mining: frequent itemsets and rules, clusters, splits of trees, Bayes, outranking."""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.relational import broadcast_if_small, running_total
from quarry.session import cut_lineage


def frequent_itemsets(baskets: DataFrame, least: float, basket: str = "basket", item: str = "item", most: int | None = None) -> DataFrame:
    """items (sorted array), n and support of all itemsets with at least ``least`` support, or those of up to ``most`` items.

    Level by level: sets of k - 1 items that share all but the last are joined to candidates, candidates
    with an infrequent subset are pruned, and the rest are counted on baskets that hold them.
    """
    # Like baskets are counted as one, and written once: all levels read them. One of nulls alone is empty, but counts.
    whole = baskets.groupBy(basket).agg(F.sort_array(F.collect_set(item)).alias("has"))
    has = cut_lineage(whole.groupBy("has").agg(F.count(F.lit(1)).alias("times")))
    total = has.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    level = cut_lineage(has.select("times", F.explode("has").alias(item)).groupBy(item).agg(F.sum("times").alias("n")).where(F.col("n") >= least * total).select(F.array(item).alias("items"), "n"))
    held = has.select("has", "times", F.explode(F.transform("has", lambda x: F.array(x))).alias("items")).join(broadcast_if_small(level.select("items")), "items")
    found = level
    for k in count(2) if most is None else range(2, most + 1):
        if level.isEmpty():
            break
        left = level.select(F.slice("items", 1, k - 2).alias("p") if k > 2 else F.lit("").alias("p"), F.col("items").alias("a"))
        candidates = left.join(left.toDF("p", "b"), "p").where(F.element_at("a", -1) < F.element_at("b", -1)).select(F.concat("a", F.slice("b", k - 1, 1)).alias("items"))
        if k > 2:
            subsets = candidates.select("items", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.filter("items", lambda x, j: j != i))).alias("sub"))
            whole = subsets.join(level.select(F.col("items").alias("sub")), "sub").groupBy("items").agg(F.count(F.lit(1)).alias("c"))
            candidates = whole.where(F.col("c") == k).select("items")
        # Each basket extends the sets it holds by its own later items: nothing is shuffled before the counts.
        longer = held.select("has", "times", "items", F.explode(F.expr("filter(has, x -> x > element_at(items, -1))")).alias("next"))
        candidates = cut_lineage(candidates)
        if candidates.isEmpty():
            break
        held = longer.select("has", "times", F.concat("items", F.array("next")).alias("items")).join(broadcast_if_small(candidates), "items")
        level = cut_lineage(held.groupBy("items").agg(F.sum("times").alias("n")).where(F.col("n") >= least * total))
        found = found.unionByName(level)
    return found.select("items", F.col("n").cast("long").alias("n"), (F.col("n") / F.lit(total)).alias("support"))


def association_rules(itemsets: DataFrame, least: float) -> DataFrame:
    """antecedent, consequent (sorted arrays of any size), support, confidence, lift, conviction of confident rules.

    Zero denominators give 0; conviction of a sure rule is infinite.
    """
    subsets = itemsets.where(F.size("items") > 1).select(
        "items", "support", F.explode(F.expr("sequence(1, cast(pow(2, size(items)) as int) - 2)")).alias("mask")
    )
    parts = subsets.select("items", "support", F.expr("filter(items, (x, j) -> (shiftright(mask, j) & 1) = 1)").alias("antecedent"), F.expr("filter(items, (x, j) -> (shiftright(mask, j) & 1) = 0)").alias("consequent"))
    known = itemsets.select("items", "support")
    joined = parts.join(known.toDF("antecedent", "sa"), "antecedent").join(known.toDF("consequent", "sc"), "consequent")
    confidence = F.coalesce(F.try_divide("support", "sa"), F.lit(0.0))
    with_c = joined.withColumn("confidence", confidence).where(F.col("confidence") >= least)
    return with_c.select(
        "antecedent", "consequent", "support", "confidence",
        F.coalesce(F.try_divide("confidence", "sc"), F.lit(0.0)).alias("lift"),
        F.when(F.col("confidence") >= 1, float("inf")).otherwise((1 - F.col("sc")) / (1 - F.col("confidence"))).alias("conviction"),
    )


def kmeans_step(points: DataFrame, centres: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """One step: assignments (key, cluster: nearest centre, the first of equals) and new centres; an empty cluster keeps its old one.

    ``centres`` (cluster and columns) are the model, k rows.
    """
    c = centres.select("cluster", *[F.col(x).alias(f"_{x}") for x in columns])
    distance = reduce(lambda a, b: a + b, [F.pow(F.col(x) - F.col(f"_{x}"), 2) for x in columns])
    near = points.crossJoin(broadcast_if_small(c)).groupBy(key, *columns).agg(F.min(F.struct(distance.alias("d"), "cluster")).alias("m"))
    assigned = near.select(key, *columns, F.col("m.cluster").alias("cluster"))
    means = assigned.groupBy("cluster").agg(*[F.avg(x).alias(f"_{x}") for x in columns])
    moved = centres.join(means, "cluster", "left").select("cluster", *[F.coalesce(f"_{x}", x).alias(x) for x in columns])
    return assigned, moved


def entropy_of(counts: Column) -> Column:
    """Entropy in bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def information_gain(df: DataFrame, target: str, attribute: str) -> DataFrame:
    """gain and gain_ratio of an attribute: one row. No spread in the attribute gives ratio 0."""
    cells = df.groupBy(attribute, target).agg(F.count(F.lit(1)).cast("double").alias("n"))
    per_value = cells.groupBy(attribute).agg(F.sum("n").alias("m"), F.collect_list("n").alias("ns")).select("m", entropy_of(F.col("ns")).alias("h"))
    classes = cells.groupBy(target).agg(F.sum("n").alias("m")).agg(F.collect_list("m").alias("ms")).select(entropy_of(F.col("ms")).alias("h_all"))
    split = per_value.agg((F.sum(F.col("m") * F.col("h")) / F.sum("m")).alias("h_split"), F.collect_list("m").alias("ms")).select("h_split", entropy_of(F.col("ms")).alias("intrinsic"))
    gain = F.col("h_all") - F.col("h_split")
    return classes.crossJoin(split).select(gain.alias("gain"), F.coalesce(F.try_divide(gain, F.col("intrinsic")), F.lit(0.0)).alias("gain_ratio"))  # one row each


def best_split(df: DataFrame, value: str, target: str) -> DataFrame:
    """The threshold between neighbouring values that leaves the least entropy of a 0/1 target: threshold, entropy."""
    steps = df.groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(target).cast("double").alias("ones"))
    steps = steps.where(F.col(value).isNotNull()).withColumnRenamed(value, "v")
    # Each value's sums and place; the next value is that of the next place.
    numbered = running_total(steps, ["v"], F.lit(1).cast("long"), "place")
    sums = cut_lineage(running_total(running_total(numbered, ["v"], F.col("n"), "ln"), ["v"], F.col("ones"), "l1"))
    totals = sums.agg(F.sum("n").alias("tn"), F.sum("ones").alias("t1"))
    after = sums.select((F.col("place") - 1).alias("place"), F.col("v").alias("next"))
    at = sums.join(after, "place", "left").crossJoin(F.broadcast(totals))  # one row
    left = entropy_of(F.array("l1", F.col("ln") - F.col("l1")))
    right = entropy_of(F.array(F.col("t1") - F.col("l1"), F.col("tn") - F.col("ln") - F.col("t1") + F.col("l1")))
    cost = (F.col("ln") * left + (F.col("tn") - F.col("ln")) * right) / F.col("tn")
    return at.where("next is not null").select(((F.col("v") + F.col("next")) / 2).alias("threshold"), cost.alias("entropy")).orderBy("entropy", "threshold").limit(1)


def bernoulli_bayes(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Class priors and smoothed probabilities of 0/1 features: label, prior, and p_<feature> for each."""
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    per = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f).alias(f"_{f}") for f in features])
    return per.crossJoin(F.broadcast(n)).select("label", (F.col("_n") / F.col("_total")).alias("prior"), *[((F.col(f"_{f}") + alpha) / (F.col("_n") + 2 * alpha)).alias(f"p_{f}") for f in features])


def stratified_folds(df: DataFrame, target: str, order: str, k: int) -> DataFrame:
    """Fold 0 to k - 1 of each row: every k-th row within its class, in order."""
    return df.withColumn("fold", F.pmod(F.row_number().over(W.partitionBy(target).orderBy(order)) - 1, F.lit(k)).cast("int"))


def outranking(alternatives: DataFrame, criteria: dict[str, dict], majority: float, key: str = "name") -> DataFrame:
    """a, b, concordance, vetoed, outranks for all ordered pairs of a small set of alternatives.

    A criterion: gain (bool), weight, q, p, v. Concordance is 1 within q, 0 beyond p, linear between. A
    difference of v or more against a vetoes that a outranks b.
    """
    a = alternatives.select(F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in criteria])
    b = alternatives.select(F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in criteria])
    against = {c: (F.col(f"b_{c}") - F.col(f"a_{c}")) if s["gain"] else (F.col(f"a_{c}") - F.col(f"b_{c}")) for c, s in criteria.items()}
    partial = lambda d, s: F.when(d <= s["q"], 1.0).when(d > s["p"], 0.0).otherwise((s["p"] - d) / (s["p"] - s["q"]))
    total = sum(s["weight"] for s in criteria.values())
    concordance = reduce(lambda x, y: x + y, [partial(against[c], s) * s["weight"] for c, s in criteria.items()]) / total
    vetoed = reduce(lambda x, y: x | y, [against[c] >= s["v"] for c, s in criteria.items() if s.get("v") is not None] or [F.lit(False)])
    pairs = a.crossJoin(broadcast_if_small(b)).where("a != b")
    return pairs.select("a", "b", concordance.alias("concordance"), vetoed.alias("vetoed"), ((concordance >= majority) & ~vetoed).alias("outranks"))


def one_hot_baskets(rows: DataFrame, basket: str, item: str, items: list[str]) -> DataFrame:
    """A row for each basket with a 0/1 column for each of ``items``."""
    return rows.groupBy(basket).agg(*[F.max(F.when(F.col(item) == x, 1).otherwise(0)).alias(x) for x in items])


def elbow(costs: DataFrame, k: str = "k", cost: str = "cost") -> DataFrame:
    """``costs`` (a row for each k) with each point's distance from the line between the ends, and the second difference of costs."""
    ends = costs.agg(F.min(F.struct(k, cost)).alias("a"), F.max(F.struct(k, cost)).alias("b"))
    rows = costs.crossJoin(F.broadcast(ends))  # one row
    run, rise = F.col("b")[k] - F.col("a")[k], F.col("b")[cost] - F.col("a")[cost]
    distance = F.abs(rise * (F.col(k) - F.col("a")[k]) - run * (F.col(cost) - F.col("a")[cost])) / F.sqrt(rise * rise + run * run)
    w = W.orderBy(k)  # over a row for each k
    return rows.select(k, cost, distance.alias("distance"), (F.lead(cost).over(w) - 2 * F.col(cost) + F.lag(cost).over(w)).alias("second_difference"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two clusterings beyond chance, from their contingency counts: ari, one row."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("r"))
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("c"))
    both = cells.agg(pairs(F.col("n")).alias("i"), F.sum("n").alias("t"))
    one = both.crossJoin(rows).crossJoin(columns)  # one row each
    chance = F.col("r") * F.col("c") / (F.col("t") * (F.col("t") - 1) / 2)
    return one.select(F.try_divide(F.col("i") - chance, (F.col("r") + F.col("c")) / 2 - chance).alias("ari"))


def davies_bouldin(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """The mean over clusters of the worst ratio of spreads to the distance of centres: davies_bouldin, one row."""
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    apart = lambda x, y: F.sqrt(reduce(lambda p, q: p + q, [F.pow(F.col(x(c)) - F.col(y(c)), 2) for c in columns]))
    spread = df.join(broadcast_if_small(centres), cluster).groupBy(cluster).agg(F.avg(apart(lambda c: c, lambda c: f"_{c}")).alias("s"))
    full = centres.join(spread, cluster)  # a row for each cluster
    other = full.select(F.col(cluster).alias("_other"), F.col("s").alias("s2"), *[F.col(f"_{c}").alias(f"_o{c}") for c in columns])
    pairs = full.join(other, F.col(cluster) != F.col("_other"))
    worst = pairs.groupBy(cluster).agg(F.max((F.col("s") + F.col("s2")) / apart(lambda c: f"_{c}", lambda c: f"_o{c}")).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def clamped_bayes(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Class priors and plain shares of 0/1 features, 0 and 1 clamped to .01 and .99: label, prior, p_<feature>."""
    clamp = lambda p: F.when(p == 0, 0.01).when(p == 1, 0.99).otherwise(p)
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    per = df.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_{f}") for f in features])
    return per.crossJoin(F.broadcast(total)).select("label", (F.col("_n") / F.col("_t")).alias("prior"), *[clamp(F.col(f"_{f}")).alias(f"p_{f}") for f in features])  # one row


def gaussian_likelihoods(train: DataFrame, rows: DataFrame, key: str, features: list[str], target: str) -> DataFrame:
    """key, label and joint: each class's prior times the normal densities of the features, not normalised.

    Deviations are of the population; the model is a row for each class.
    """
    total = train.count()
    model = train.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(f"{p}{f}") for f in features for p, e in (("_m", F.avg(f)), ("_s", F.stddev_pop(f)))])
    log = lambda f: -F.log(F.col(f"_s{f}") * math.sqrt(2 * math.pi)) - F.pow((F.col(f) - F.col(f"_m{f}")) / F.col(f"_s{f}"), 2) / 2
    joint = reduce(lambda a, b: a + b, [log(f) for f in features]) + F.log(F.col("_n") / total)
    return rows.crossJoin(broadcast_if_small(model)).select(key, "label", F.exp(joint).alias("joint"))


def full_covariance_posterior(train: DataFrame, rows: DataFrame, key: str, x: str, y: str, target: str) -> DataFrame:
    """key, label and p: posteriors of two features under a normal distribution with full covariance for each class."""
    total = train.count()
    model = train.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"))
    det = F.col("_vx") * F.col("_vy") - F.col("_c") * F.col("_c")
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    form = (F.col("_vy") * dx * dx - 2 * F.col("_c") * dx * dy + F.col("_vx") * dy * dy) / det
    joint = F.col("_n") / total * F.exp(-form / 2) / (2 * math.pi * F.sqrt(det))
    scored = rows.crossJoin(broadcast_if_small(model)).select(key, "label", joint.alias("_j"))
    sums = scored.groupBy(key).agg(F.sum("_j").alias("_all"))
    return scored.join(sums, key).select(key, "label", F.try_divide("_j", "_all").alias("p"))


def undersampled(df: DataFrame, target: str, key: str, seed: int = 1) -> DataFrame:
    """As many rows of each class as the smallest has: those of the least hashes of key and seed."""
    least = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return running_rank(df.withColumn("_order", order), target, ["_order", key], "_rank").where(F.col("_rank") <= least).drop("_rank", "_order")


def oversampled(df: DataFrame, target: str, key: str) -> DataFrame:
    """Rows of each class repeated in order of ``key`` until it has as many as the largest; ``copy`` counts from 0."""
    sizes = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    ranked = running_rank(df, target, [key], "_rank").join(broadcast_if_small(sizes), target)
    copies = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(most) - F.col("_rank")) / F.col("_n")))
    return ranked.withColumn("copy", F.explode(copies)).drop("_rank", "_n")


def running_rank(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Numbers from 1 within each value of ``group`` (few values), by ranges of all rows, so a large group lies in many."""
    numbered = running_total(df, [group, *order], F.lit(1).cast("long"), "_all")
    first = numbered.groupBy(F.col(group).alias("_g")).agg(F.min("_all").alias("_first"))
    return numbered.join(broadcast_if_small(first), F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_all") - F.col("_first") + 1).drop("_all", "_g", "_first")


def uncorrelated(df: DataFrame, columns: list[str], most: float) -> list[str]:
    """``columns`` without those that correlate over ``most``, either way, with one kept before."""
    pairs = {(a, b): F.abs(F.corr(F.col(a).cast("double"), F.col(b).cast("double"))) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    found = df.agg(*[e.alias(f"{a}|{b}") for (a, b), e in pairs.items()]).first().asDict()
    kept: list[str] = []
    for c in columns:
        if all((found[f"{k}|{c}"] or 0.0) <= most for k in kept):
            kept.append(c)
    return kept


def mutual_information(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """feature and gain in bits about the target, from grouped counts; a row for each feature."""
    parts = [information_gain(df, target, f).select(F.lit(f).alias("feature"), "gain") for f in features]
    return reduce(lambda a, b: a.unionByName(b), parts)
