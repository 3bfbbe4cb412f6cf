"""Exploratory operators on a DataFrame's columns: profiles, counts, encodings, scaling, outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quarry.operators.relational import running_total

#: Values up to which exact percentiles are taken in one pass; beyond, a histogram first says where they lie.
ONE_PASS, BINS = 2_000_000, 4096


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles, between neighbours in proportion, of the values that aren't null.

    Many values: a first pass counts bins, a second takes the ranks out of the bins that hold them, so no
    task holds all values.
    """
    x = F.col(column).cast("double")
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return [None] * len(shares)
    if n <= ONE_PASS or lo == hi:
        return list(df.agg(F.percentile(x, F.array(*[F.lit(float(s)) for s in shares])).alias("p")).first()["p"])
    bin_ = F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("int")
    counts = {r["b"]: r["n"] for r in df.where(x.isNotNull()).groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # BINS rows at most
    wanted = sorted({k for s in shares for k in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))})
    first, base = {}, 0
    for b in sorted(counts):
        first[b], base = base, base + counts[b]
    homes = {k: max(b for b in first if first[b] <= k) for k in wanted}
    chosen = df.where(x.isNotNull() & bin_.isin(sorted(set(homes.values())))).groupBy(bin_.alias("b"), x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("b").orderBy("x"))
    ranked = chosen.withColumn("upto", upto)
    at: dict[int, float] = {}
    tests = [F.min(F.when((F.col("b") == b) & (F.col("upto") > k - first[b]), F.col("x"))).alias(str(k)) for k, b in homes.items()]
    row = ranked.agg(*tests).first()
    at = {k: row[str(k)] for k in homes}
    out = []
    for s in shares:
        place = s * (n - 1)
        a, b = at[int(place)], at[min(int(place) + 1, n - 1)]
        out.append(a + (b - a) * (place - int(place)))
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def unpivoted(df: DataFrame, exprs: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation of all ``exprs`` (row name -> column name -> aggregate), one output row per row name."""
    flat = {f"{r}|{c}": e for r, cs in exprs.items() for c, e in cs.items()}
    one = df.agg(*[e.alias(k) for k, e in flat.items()])
    rows = [F.struct(F.lit(r).alias("column"), *[F.col(f"`{r}|{c}`").alias(c) for c in cs]) for r, cs in exprs.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample standard deviation, least, exact quartiles and greatest of numeric columns."""
    quarters = {c: percentiles(df, c, [0.25, 0.5, 0.75]) for c in columns or numeric_columns(df)}
    stats = lambda c: {
        "n": F.count(c).cast("long"), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c).cast("double"),
        **{name: F.max(F.lit(q).cast("double")) for name, q in zip(("q25", "median", "q75"), quarters[c], strict=True)}, "max": F.max(c).cast("double"),
    }
    return unpivoted(df, {c: stats(c) for c in quarters})


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return unpivoted(df, {c: {"nulls": F.count_if(F.col(c).isNull()).cast("long"), "distinct_values": F.count_distinct(c).cast("long")} for c in columns or df.columns})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of each value and their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))  # a one-row side


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts by ``row`` with a column for each of ``values``, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)).cast("long")).fillna(0)


def dummies(df: DataFrame, column: str, values: list[str], drop_first: bool = False) -> DataFrame:
    kept = sorted(values)[1:] if drop_first else sorted(values)
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in kept}).drop(column)


def row_idxmax(columns: list[str]) -> Column:
    """The name of the first column that holds the row's greatest value."""
    best = F.greatest(*columns)
    return reduce(lambda c, name: c.when(F.col(name) == best, name), columns, F.when(F.lit(False), ""))


def scaled(df: DataFrame, column: str, name: str, how: str = "minmax") -> DataFrame:
    """Min-max or z-score (population) scaling by one aggregation joined back; constant columns give null."""
    lo, width = (F.min(column), F.max(column) - F.min(column)) if how == "minmax" else (F.avg(column), F.stddev_pop(column))
    facts = df.agg(lo.alias("_lo"), width.alias("_width"))
    return df.crossJoin(F.broadcast(facts)).withColumn(name, (F.col(column) - F.col("_lo")) / F.nullif("_width", F.lit(0.0))).drop("_lo", "_width")


def iqr_outliers(df: DataFrame, column: str, factor: float = 2.0) -> DataFrame:
    """Rows whose value lies over ``factor`` times the quartiles' distance beyond them."""
    q1, q3 = percentiles(df, column, [0.25, 0.75])
    if q1 is None:
        return df.limit(0)
    spread = factor * (q3 - q1)
    return df.where((F.col(column) < q1 - spread) | (F.col(column) > q3 + spread))


def sigma_outliers(df: DataFrame, column: str, sigmas: float = 3.0) -> DataFrame:
    m = df.agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"))
    return df.crossJoin(F.broadcast(m)).where(F.abs(F.col(column) - F.col("_m")) > sigmas * F.col("_s")).drop("_m", "_s")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs of columns with their Pearson correlation, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins over [low, high]; values outside go to bins -1 and ``bins``."""
    at = F.floor((F.col(column) - low) * bins / (high - low))
    bin_ = F.when(F.col(column) == high, bins - 1).when(F.col(column) < low, -1).otherwise(F.least(at, F.lit(bins)))
    return df.where(F.col(column).isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties at their mean, over the distinct values' counts rather than all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_total(counts, [column], F.col("_n"), name).select(F.col(column).alias("_v"), (F.col(name) - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, df[column] == F.col("_v"), "left").drop("_v")


def filled(df: DataFrame, column: str, how: str = "median") -> DataFrame:
    """Nulls replaced by the exact median, the mean, or the mode (smallest of equals)."""
    if how == "median":
        return df.withColumn(column, F.coalesce(column, F.lit(percentiles(df, column, [0.5])[0])))
    if how == "mode":
        fact = df.where(F.col(column).isNotNull()).groupBy(column).count().agg(F.min_by(column, F.struct(-F.col("count"), F.col(column))).alias("_fill"))
    else:
        fact = df.agg(F.avg(column).alias("_fill"))
    return df.crossJoin(F.broadcast(fact)).withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def deduplicated(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row of each combination of ``keys``: the first or the last in ``order``."""
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return one.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def without_labels(df: DataFrame, column: str, labels: list) -> DataFrame:
    """``df`` without the rows of these labels; a label that no row has raises KeyError."""
    found = {r[0] for r in df.where(F.col(column).isin(labels)).select(column).distinct().collect()}  # at most the labels given
    if missing := [x for x in labels if x not in found]:
        raise KeyError(missing)
    return df.where(~F.col(column).isin(labels) | F.col(column).isNull())


KINDS = {"number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "object": ("string", "array", "map", "struct", "binary"), "datetime": ("date", "timestamp", "timestamp_ntz"), "bool": ("boolean",)}


def of_kind(df: DataFrame, *kinds: str) -> DataFrame:
    """The columns whose types are of one of ``kinds``: number, object, datetime, bool."""
    wanted = tuple(x for k in kinds for x in KINDS[k])
    return df.select(*[c for c, t in df.dtypes if t.split("(")[0].split("<")[0] in wanted])


def projected(df: DataFrame, fields: dict[str, int], key: str) -> DataFrame:
    """A document projection: fields with 1 are kept, or those with 0 left out; mixing raises, but for the key."""
    others = {v for c, v in fields.items() if c != key}
    if len(others) > 1:
        raise ValueError("a projection keeps fields or leaves fields out, not both")
    if others == {0} or not others:
        return df.drop(*[c for c, v in fields.items() if v == 0])
    kept = [c for c in df.columns if fields.get(c) == 1 or c == key and fields.get(key, 1)]
    return df.select(*kept)


def nulls_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.count_if(F.col(c).isNull()).cast("long").alias(c) for c in columns])


def nan_sum(columns: list[str]) -> Column:
    """The sum of a row's columns, null and NaN as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])


def row_mean(columns: list[str]) -> Column:
    """The mean of a row's columns that are neither null nor NaN; null without any."""
    known = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 0).otherwise(1) for c in columns])
    return F.try_divide(nan_sum(columns), known)


def ordered_category(column: str, order: list[str]) -> Column:
    """The place of a value in ``order``, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)) - 1


def without_nulls(df: DataFrame, how: str = "any", columns: list[str] | None = None, least: int | None = None) -> DataFrame:
    """Rows without any null, not of nulls alone, or with ``least`` values at least, in ``columns``."""
    return df.na.drop(how, least, columns)


def side_by_side(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str]) -> DataFrame:
    """The n-th row of one beside the n-th of the other; the shorter one is filled up with nulls."""
    a, b = (running_total(df, order, F.lit(1).cast("long"), "_n") for df, order in ((left, left_order), (right, right_order)))
    return a.join(b, "_n", "full").drop("_n")


def aligned(left: DataFrame, right: DataFrame, key: str, value: str, how) -> DataFrame:
    """Arithmetic of two labelled series: key and value; a label that one lacks gives null."""
    return left.select(key, F.col(value).alias("_a")).join(right.select(key, F.col(value).alias("_b")), key, "full").select(key, how(F.col("_a"), F.col("_b")).alias(value))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, those of the least hashes of key and seed: the same on each run and on any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def fitted_scaling(train: DataFrame, rows: DataFrame, column: str, name: str, how: str = "minmax") -> DataFrame:
    """``rows`` scaled by the least and greatest, or mean and deviation, of ``train``."""
    lo, width = (F.min(column), F.max(column) - F.min(column)) if how == "minmax" else (F.avg(column), F.stddev_pop(column))
    facts = train.agg(lo.alias("_lo"), width.alias("_width"))
    return rows.crossJoin(F.broadcast(facts)).withColumn(name, (F.col(column) - F.col("_lo")) / F.nullif("_width", F.lit(0.0))).drop("_lo", "_width")  # one row


def money(text: Column) -> Column:
    """An amount written with a currency sign and thousands' commas; null if it isn't one."""
    return F.regexp_replace(text, r"[$€£,\s]", "").try_cast("double")


def reshaped(values: Column, width: int) -> Column:
    """An array in rows of ``width``; the last may be shorter."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(width)), lambda i: i <= F.size(values))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(width)))


def transposed(rows: Column) -> Column:
    """An array of equally long arrays, rows for columns."""
    columns = F.filter(F.sequence(F.lit(1), F.greatest(F.size(F.get(rows, F.lit(0))), F.lit(1))), lambda i: i <= F.size(F.get(rows, F.lit(0))))
    return F.transform(columns, lambda i: F.transform(rows, lambda r: F.try_element_at(r, i)))


def gathered(values: Column, places: Column) -> Column:
    """The elements at ``places`` (from 0); null beyond the ends."""
    return F.transform(places, lambda i: F.get(values, i))


def argsort(values: Column) -> Column:
    """Places (from 0) of an array's elements in ascending order, the first of equals first."""
    return F.transform(F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])


def factorial(n: Column) -> Column:
    """n! by a product over 1 to n, as double; null below 0."""
    return F.when(n >= 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1.0), lambda p, k: p * k))


def primes_up_to(df: DataFrame, n: int) -> DataFrame:
    """A sieve: numbers 2 to ``n`` that no multiple of a smaller number hits; each divisor writes its own multiples."""
    numbers = df.sparkSession.range(2, n + 1)
    multiples = df.sparkSession.range(2, int(n**0.5) + 1).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(n).cast("long"), F.col("id"))).alias("id"))
    return numbers.join(multiples, "id", "left_anti").select(F.col("id").alias("prime"))
