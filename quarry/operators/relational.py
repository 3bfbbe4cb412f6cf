"""Relational operators that need more than one built-in call: joins, ranking, hierarchies, rows as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import cut_lineage

#: A side of a join is broadcast up to so many bytes, a column reckoned as COLUMN_BYTES.
SMALL_BYTES, COLUMN_BYTES = 16 << 20, 64


def broadcast_if_small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``df`` to be broadcast if a count shows that it is small; else as it is."""
    rows = most // (COLUMN_BYTES * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Sums of ``value`` over all rows up to each in ``order``, itself included.

    Rows are dealt to ranges of ``order`` and written once; each range is summed up in parallel and
    shifted by what lies before it. Rows alike in ``order`` lie in one range, in no fixed order.
    """
    ranged = df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))  # a row for each range
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    upto = F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, upto).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_value", "_base")


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of ``left`` with those of ``right`` whose closed interval [low, high] holds ``value``.

    Intervals are dealt to all the cells of ``width`` that they touch, values to one, and an equi-join on
    the cell is filtered: no nested loop, whatever the sizes.
    """
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    dealt = right.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(cells))
    placed = left.withColumn("_cell", F.floor(F.col(value) / width))
    return placed.join(dealt, "_cell").where(F.col(value).between(F.col(low), F.col(high))).drop("_cell")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each row of ``left`` with the latest ``value`` of ``right`` of its key at or before its time, by one sorted pass."""
    events = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    last = F.last("_v", ignorenulls=True).over(W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn(value, last).where("_side = 1").drop("_t", "_side", "_v")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, ties: bool = True) -> DataFrame:
    """The first ``n`` of each group; with ``ties``, all that rank as high."""
    rank = (F.rank() if ties else F.row_number()).over(W.partitionBy(*group).orderBy(*order) if group else W.orderBy(*order))
    return df.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n)


def arg_max_rows(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The rows of each group that hold its greatest ``value``, all of equals."""
    best = df.groupBy(*group).agg(F.max(value).alias("_best"))
    return df.join(best, group).where(F.col(value) == F.col("_best")).drop("_best")


def deviation_from_group(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``value`` less its group's mean: groups are aggregated and joined back, so a large one isn't gathered."""
    means = df.groupBy(F.col(group).alias("_group")).agg(F.avg(value).alias("_mean"))
    return df.join(broadcast_if_small(means), F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(value) - F.col("_mean")).drop("_group", "_mean")


def lookup_array(left: DataFrame, right: DataFrame, left_key: str, right_key: str, into: str) -> DataFrame:
    """Each row of ``left`` with the array of all matching rows of ``right``, empty if none."""
    lists = right.groupBy(F.col(right_key).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*right.columns))).alias(into))
    kind = lists.schema[into].dataType
    return left.join(lists, left[left_key] == F.col("_k"), "left").drop("_k").withColumn(into, F.coalesce(into, F.array().cast(kind)))


def hierarchy(nodes: DataFrame, node: str, parent: str, depth: int = 64, label: str | None = None) -> DataFrame:
    """Depth-first levels of a tree: node, level (from 1), path; roots have a null parent.

    The path holds nodes, or their ``label``, by which siblings are then ordered.

    Level by level, as a recursive query does; a level is joined to the nodes by an equi-join. A cycle
    can't be reached from a root. Stops when a level is empty.
    """
    spark = nodes.sparkSession
    nodes.select(F.col(node).alias("n"), F.col(parent).alias("p"), F.col(label or node).alias("l")).createOrReplaceTempView("_tree_nodes")
    return spark.sql(
        f"""WITH RECURSIVE tree (n, level, path) MAX RECURSION LEVEL {depth} AS (
            SELECT n, 1, array(l) FROM _tree_nodes WHERE p IS NULL
            UNION ALL SELECT c.n, t.level + 1, array_append(t.path, c.l) FROM tree t JOIN _tree_nodes c ON c.p = t.n
        ) SELECT n AS {node}, level, path FROM tree"""
    )


def update_from(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """UPDATE ... SET column from ``changes`` (key unique, new value under the same name); others keep theirs."""
    new = changes.select(F.col(key), F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def delete_matching(df: DataFrame, victims: DataFrame, key: str) -> DataFrame:
    return df.join(victims.select(key).distinct(), key, "left_anti")


def next_values(df: DataFrame, order: list[str], name: str, start: int = 1, step: int = 1) -> DataFrame:
    """A sequence's numbers, gapless in ``order``; ranges are numbered in parallel and shifted by what lies before."""
    return running_total(df, order, F.lit(1).cast("long"), "_nth").withColumn(name, (F.lit(start) + step * (F.col("_nth") - 1)).cast("long")).drop("_nth")


def violations(df: DataFrame, unique: list[str] = (), not_null: list[str] = (), checks: dict[str, Column] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """How many rows break each constraint: constraint, rows."""
    parts = [df.groupBy(c).count().where(F.col(c).isNotNull() & (F.col("count") > 1)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).select(F.lit(f"unique {c}").alias("constraint"), "rows") for c in unique]
    tests = {f"not null {c}": F.col(c).isNull() for c in not_null} | {f"check {k}": ~v for k, v in (checks or {}).items()}
    if tests:
        counted = df.agg(*[F.count_if(v).alias(k) for k, v in tests.items()])
        parts.append(counted.select(F.explode(F.array(*[F.struct(F.lit(k).alias("constraint"), F.col(f"`{k}`").alias("rows")) for k in tests])).alias("t")).select("t.*"))
    for c, (other, key) in (foreign or {}).items():
        orphans = df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias(c)).distinct(), c, "left_anti")
        parts.append(orphans.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"foreign key {c}").alias("constraint"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rows", F.col("rows").cast("long"))


def cascade_delete(tables: list[tuple[DataFrame, str, str | None]], victims: DataFrame) -> list[DataFrame]:
    """ON DELETE CASCADE down a chain of tables: (table, key, foreign key to the table before); ``victims``: keys of the first."""
    out, gone = [], victims.toDF("_gone").distinct()
    for k, (df, key, parent) in enumerate(tables):
        at = key if k == 0 else parent
        hit = df.join(gone, df[at] == F.col("_gone"), "left_semi").select(F.col(key).alias("_gone"))
        out.append(df.join(gone, df[at] == F.col("_gone"), "left_anti"))
        gone = hit.distinct()
    return out


def delete_subtrees(nodes: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """``nodes`` without ``roots`` (column of ``node``) and all below them; a level at a time, until one is empty."""
    gone = level = cut_lineage(nodes.select(node).join(roots.select(node).distinct(), node, "left_semi").distinct())
    while True:
        below = nodes.select(F.col(node).alias("_n"), F.col(parent).alias(node)).join(level, node, "left_semi").select(F.col("_n").alias(node)).distinct()
        level = cut_lineage(below.join(gone, node, "left_anti"))
        if level.isEmpty():
            return nodes.join(gone, node, "left_anti")
        gone = gone.union(level)


def ancestors(edges: DataFrame, child: str, parent: str, of) -> DataFrame:
    """ancestor and distance (from 1) of one node, parents of parents, until there are none; a cycle ends where it closes."""
    found, at, distance = None, [of], 1
    seen = {of}
    while at:
        rows = edges.where(F.col(child).isin(at)).where(F.col(parent).isNotNull()).select(F.col(parent).alias("ancestor")).distinct()
        at = [r[0] for r in rows.collect() if r[0] not in seen]  # the parents of a node
        seen.update(at)
        step = edges.sparkSession.createDataFrame([(x, distance) for x in at], f"ancestor {edges.schema[parent].dataType.simpleString()}, distance int")
        found, distance = step if found is None else found.union(step), distance + 1
    return found


def with_defaults(df: DataFrame, key: str, order: list[str], start: int, defaults: dict) -> DataFrame:
    """What an insert trigger fills in: null keys get numbers of a sequence from ``start`` in ``order``, other columns their default."""
    missing = next_values(df.where(F.col(key).isNull()), order, key, start)
    return df.where(F.col(key).isNotNull()).unionByName(missing.select(*df.columns)).fillna(defaults)


def adjusted_counts(counts: DataFrame, key: str, name: str, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """Kept counts after rows came and went, from the changes alone; null keys count nowhere, new keys start at 0."""
    changes = inserted.select(key, F.lit(1).alias("_d")).union(deleted.select(key, F.lit(-1))).where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_d").alias("_d"))
    return counts.join(changes, key, "full").select(key, (F.coalesce(name, F.lit(0)) + F.coalesce("_d", F.lit(0))).cast("long").alias(name))


def label_slice(df: DataFrame, order: str, first, last) -> DataFrame:
    """Rows from label ``first`` to label ``last``, both included."""
    return df.where(F.col(order).between(first, last))


def position_slice(df: DataFrame, order: str, begin: int, end: int) -> DataFrame:
    """Rows at positions ``begin`` (from 0) up to but not including ``end``, in order."""
    return df.orderBy(order).offset(begin).limit(max(0, end - begin))


def check_option(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that a view with this condition would refuse: those where it isn't true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def guarded_delete(df: DataFrame, key: str, victims: DataFrame, children: DataFrame, child_key: str) -> DataFrame:
    """``df`` without ``victims``, unless a victim still has children: then it raises."""
    held = victims.select(key).join(children.select(F.col(child_key).alias(key)), key, "left_semi").limit(5).collect()
    if held:
        raise ValueError(f"rows still have children: {[r[0] for r in held]}")
    return delete_matching(df, victims, key)


def next_id(df: DataFrame, key: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).cast("long").alias("next_id"))


def audited(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What a row trigger would log between two states: key, action, and old and new values of what changed."""
    o, n = old.select(F.col(key), F.struct(*columns).alias("old")), new.select(F.col(key), F.struct(*columns).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    return o.join(n, key, "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, action.alias("action"), "old", "new")
