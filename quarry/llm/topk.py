"""Exact top-k by an impact-ordered index, score at a time.

Vectors are cut into blocks, those of the same greatest dimension together. A block's index holds for
each dimension posting segments (vectors and their components there) of equal quantised impact, the
impact being the component's absolute value in powers of two. A query takes the segments of all its
dimensions in descending order of its own weight there times their impact, and each adds its postings'
part to the accumulators. What a vector's postings not yet taken can still add is bounded by the query's
norm times the norm of those postings. After each of a few stages this gives bounds of all scores; a
vector whose upper bound is below the k-th best lower bound is proven out. The search stops when the
possible members are so few that rescoring them in whole numbers costs less than going on.

Each query first searches the block that holds the vectors most like it. Its k-th best score there is
carried to all other blocks as a lower bound, so that most of their vectors, or a whole block by its
bounds, are proven out early. Blocks of queries meet blocks of vectors by an equi-join on the block's
number; each pair gives its own best k, of which the best k of a query are its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, stored, table

#: Vectors of a block and queries of a block.
BLOCK, QUERIES = 8192, 512
#: Shares of a block's postings after which bounds are taken; a posting costs about as much as that many components rescored.
STAGES, RESCORE = (0.02, 0.08, 0.2, 0.4, 0.7, 1.0), 4
#: The least lower bound: that of a query that has searched nothing.
NONE = -(1 << 62)


def quantised(embedding: Column, scale: int = 256) -> Column:
    """Whole numbers floor(scale * x); null if the vector is null or holds a null or non-finite component."""
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(sound, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


class BlockIndex:
    """Posting segments of a block of vectors (rows of int64): one for each dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.x = ids, vectors
        self.doubles = vectors.astype(np.float64)
        size = np.abs(self.doubles)
        self.squares = (size**2).sum(1)
        self.longest = float(np.sqrt(self.squares.max(initial=0.0)))
        self.high, self.low = (f(axis=0).astype(np.float64) for f in (vectors.max, vectors.min))
        rows, dims = np.nonzero(vectors)
        level = np.frexp(size[rows, dims])[1]  # impacts from 2 ** (level - 1) on, below 2 ** level
        order = np.lexsort((level, dims))
        rows, dims, level = rows[order], dims[order], level[order]
        self.rows, self.values = rows, vectors[rows, dims].astype(np.float64)
        first = np.flatnonzero(np.concatenate([[True], (dims[1:] != dims[:-1]) | (level[1:] != level[:-1])])) if len(rows) else np.zeros(0, np.int64)
        self.begin, self.end = first, np.append(first[1:], len(rows))
        self.dim, self.impact = dims[first], np.exp2(level[first])

    def search(self, own: int, query: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """The best ``k`` (score, vec_id), of at least ``least``, of all vectors but the query's own, ties to the smaller vec_id."""
        q = query.astype(np.float64)
        norm = float(np.sqrt((q**2).sum()))
        if min(norm * self.longest, float(np.maximum(q * self.high, q * self.low).sum())) * (1 + 1e-9) + 0.5 < least:
            return []
        weight = np.abs(q)[self.dim] * self.impact
        order = np.argsort(-weight)[: int((weight > 0).sum())]
        upto = np.cumsum(self.end[order] - self.begin[order])
        total = int(upto[-1]) if len(upto) else 0
        n = len(self.ids)
        scores, left = np.zeros(n), self.squares.copy()
        barred = self.ids == own
        alive, done = ~barred, 0
        for share in STAGES:
            stop = int(np.searchsorted(upto, share * total)) + 1
            for s in order[done:stop].tolist():
                r, v = self.rows[self.begin[s] : self.end[s]], self.values[self.begin[s] : self.end[s]]
                scores[r] += q[self.dim[s]] * v
                left[r] -= v * v
            done = stop
            bound = norm * np.sqrt(np.maximum(left, 0.0)) + 1e-12 * norm * self.longest + 0.5
            limit = float(least)
            if n > k:
                low = np.where(barred, -np.inf, scores - bound)
                limit = max(limit, float(np.partition(low, n - k)[n - k]))
            alive = ~barred & (scores + bound >= limit)
            if int(alive.sum()) * self.x.shape[1] <= RESCORE * (total - (int(upto[done - 1]) if done <= len(upto) else total)):
                break
        members = np.flatnonzero(alive)
        if 4 * len(members) > n and norm * self.longest < 1 << 52:  # whole numbers that doubles hold exactly
            exact = (self.doubles @ q).astype(np.int64)[members]
        else:
            exact = self.x[members] @ query
        if len(members) > 4 * k:  # the k-th best and its ties
            top = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
            members, exact = members[top], exact[top]
        best = np.lexsort((self.ids[members], -exact))[:k]
        return [(int(exact[b]), int(self.ids[members[b]])) for b in best if exact[b] >= least]


def _greatest(v: Column) -> Column:
    """The dimension of the greatest absolute component, with its sign: from 1, negative below zero; 0 without components."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    at = F.array_position(F.transform(v, lambda x: F.abs(x)), top)
    return F.coalesce(F.when(F.size(v) > 0, at * F.signum(F.try_element_at(v, at.cast("int")))), F.lit(0)).cast("int")


def _lists(rows: DataFrame, number: Column, prefix: str) -> DataFrame:
    """One row per block: its number, ids and components."""
    return rows.groupBy(number.alias(f"{prefix}_block")).agg(F.collect_list(F.struct("id", "v", "least")).alias("r")).select(
        f"{prefix}_block", F.col("r.id").alias(f"{prefix}_ids"), F.col("r.v").alias(f"{prefix}_vs"), F.col("r.least").alias(f"{prefix}_least")
    )


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` candidates of greatest inner product for each query: query_id, rank (from 1), vec_id, score.

    Both sides: id long, v array<bigint>; other columns are ignored. A query's own id is no candidate of
    it. Rows with null id or vector take no part; a shorter vector counts as filled up with zeros;
    repeated rows are candidates each. Fewer candidates than ``k`` give as many rows. Two queries of one
    id are asked as one, by either vector.
    """
    c, q = (
        # A row's place is written, so that repeated rows are dealt evenly and alike each time.
        stored(df.select("id", "v").where("id is not null and v is not null").select("id", "v", _greatest(F.col("v")).alias("great"), F.monotonically_increasing_id().alias("place")))
        for df in (candidates, queries.dropDuplicates(["id"]))
    )
    width = max(df.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0] for df in (c, q))
    # Vectors of one greatest dimension lie in neighbouring blocks of about BLOCK; this table has 2 * width + 1 rows at most.
    sizes = sorted((r["great"], r["n"]) for r in c.groupBy("great").agg(F.count(F.lit(1)).alias("n")).collect())
    homes: dict[int, tuple[int, int]] = {}
    block, room = 0, BLOCK
    for great, n in sizes:
        if n > room and room < BLOCK:
            block, room = block + 1, BLOCK
        parts = max(1, -(-n // BLOCK))
        homes[great] = (block, parts)
        block, room = (block + parts, BLOCK) if parts > 1 or n >= room else (block, room - n)
    nb = max((b + n for b, n in homes.values()), default=1)
    home = F.create_map(*[F.lit(x) for g, (b, _) in homes.items() for x in (g, b)]) if homes else F.create_map(F.lit(0), F.lit(0))
    parts = F.create_map(*[F.lit(x) for g, (_, n) in homes.items() for x in (g, n)]) if homes else F.create_map(F.lit(0), F.lit(1))
    own = F.coalesce(F.try_element_at(home, F.col("great")) + F.pmod(F.xxhash64("place"), F.try_element_at(parts, F.col("great"))), F.lit(0)).cast("int")
    nq = max(1, -(-q.count() // QUERIES))

    def matrix(lists: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(lists), width), np.int64)
        for n, x in enumerate(lists):
            out[n, : len(x)] = x
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for b in batches:
            for block, ids, vs, asked, qs, least in zip(*(b.column(n).to_pylist() for n in range(6)), strict=True):
                if block != held:
                    held, index = block, BlockIndex(np.array(ids, np.int64), matrix(vs))
                rows = [(o, i, s) for o, v, x in zip(asked, matrix(qs), least, strict=True) for s, i in index.search(o, v, k, x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

    blocks = stored(_lists(c.withColumn("least", F.lit(None).cast("long")), own, "c").select("c_block", "c_ids", "c_vs"))

    def best(asked: DataFrame) -> DataFrame:
        pairs = blocks.join(asked.hint("shuffle_hash"), "c_block").select("c_block", "c_ids", "c_vs", "q_ids", "q_vs", "q_least")
        found = map_arrow(pairs, search, "query_id long, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)

    # First each query asks its own block, in lists of bounded length; then all others, with what it got.
    salted = q.withColumn("least", F.lit(NONE)).withColumn("at", own)
    queries_of = salted.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("lists"))  # a row for each block
    seeds = salted.join(queries_of, "at").groupBy("at", F.pmod(F.xxhash64("id"), "lists").alias("list")).agg(F.collect_list(F.struct("id", "v", "least")).alias("r"))
    first = stored(best(seeds.select(F.col("at").alias("c_block"), F.col("r.id").alias("q_ids"), F.col("r.v").alias("q_vs"), F.col("r.least").alias("q_least"))))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    carried = salted.join(bounds, "id", "left").withColumn("least", F.coalesce("bound", "least"))
    asked = carried.groupBy(F.pmod(F.xxhash64("id"), F.lit(nq)).alias("list")).agg(F.collect_list(F.struct("id", "v", "least", "at")).alias("r"))
    asked = asked.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("r", F.filter("r", lambda x: x["at"] != F.col("c_block"))).where(F.size("r") > 0)
    rest = best(asked.select("c_block", F.col("r.id").alias("q_ids"), F.col("r.v").alias("q_vs"), F.col("r.least").alias("q_least")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    both = first.select("query_id", "vec_id", "score").unionByName(rest.select("query_id", "vec_id", "score"))
    return both.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("id % 50 = 0"), 5)


OP2_SQL = """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
