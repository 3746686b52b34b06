"""Exact top-k search by columnar branch and bound over vertically stored vectors.

Vectors are dealt into blocks and stored by dimension, each dimension of a block in one piece. A task takes one
block of queries and one of candidates. It adds up inner products a few dimensions at a time for all candidates
that are still in; what the dimensions to come can add is at most the product of the remaining norms (the
remaining mass). A candidate whose sum plus that bound stays below the query's k-th best lower bound is
dropped, and the survivors' columns are compacted. Where there are several blocks of candidates, one is searched
first, and its k-th best scores bound the search of the others from the start. What each pair of blocks keeps, at
most k rows a query, is merged by a window that needs k rows of each block only.

Components are floor(scale * x) with x as double, as integers; sums are exact (in 53 bits where they
fit, else by Python integers and without bounds; a score beyond 64 bits is cut to the nearest one). Null vectors and
those with null or non-finite components take no part. Vectors of other lengths are not compared
with each other. Every row is a candidate to every query but itself: a row that repeats counts as often as it
occurs, also to its copies, and rows that share an id are each a query. Ties go to the smaller id. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import common

CANDIDATES, QUERIES, STEP = 8192, 1024, 16


def block_top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's best k: q[queries, dims], x[dims, candidates]. copies: how often each
    candidate occurs; own: of each query, which candidate is the row itself (-1: none), once less. floor: scores that
    the k-th best of each query reaches at least."""
    n_dims, n = x.shape
    exact = q.dtype != object
    if exact:
        x = np.ascontiguousarray(x, np.float64)
        q2, x2 = (np.cumsum((m**2)[::-1], axis=0)[::-1] for m in (q.T, x))
    first = min(STEP, n_dims) if exact else n_dims
    start = q[:, :first] @ x[:first] if n_dims else np.zeros((len(q), n))
    out = []
    for i in range(len(q)):
        times = copies
        if own[i] >= 0:
            times = copies.copy()
            times[own[i]] -= 1
        alive = np.flatnonzero(times > 0)
        part, rest, mass, at = start[i, alive], x[first:, alive] if len(alive) < n else x[first:], None, first
        if at < n_dims:
            mass = x2[at:, alive] if len(alive) < n else x2[at:]
        while at < n_dims:
            if len(alive) > k or floor is not None:
                bound = np.sqrt(q2[at, i] * mass[0]) * (1 + 1e-12) + 1e-6
                sure = np.partition(part - bound, len(alive) - k)[len(alive) - k] if len(alive) > k else -np.inf
                if floor is not None:
                    sure = max(sure, floor[i])
                stay = part + bound >= sure - 1e-6
                if stay.sum() < 0.7 * len(stay):  # the survivors' columns move together
                    alive, part, rest, mass = alive[stay], part[stay], rest[:, stay], mass[:, stay]
            to = min(at + STEP, n_dims)
            part = part + q[i, at:to] @ rest[: to - at]
            rest, mass, at = rest[to - at :], mass[to - at :], to
        if len(alive) > k:
            keep = part >= np.sort(part)[len(part) - k]
            alive, part = alive[keep], part[keep]
        best = np.lexsort((ids[alive], -part if exact else np.array([-int(s) for s in part], object)))[:k]
        best = np.repeat(best, np.minimum(times[alive[best]], k))[:k]
        out += [(i, alive[b], min(max(int(part[b]), -(1 << 63)), (1 << 63) - 1)) for b in best.tolist()]
    rows = np.array(out, object).reshape(-1, 3)
    return rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64)


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component: float64 if sums of products stay exact, else Python integers."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * values)
    if np.abs(out).max(initial=0) ** 2 * max(values.shape[-1], 1) < 2.0**52:
        return out
    return np.array([[math.floor(Fraction(scale) * Fraction(float(v))) for v in row] for row in values], object).reshape(values.shape)


def search(vectors: DataFrame, *, k: int = 5, scale: float = 256.0, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries: rows whose id is divisible by `every`."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.coalesce(sound, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    rows = rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("m")).withColumns({"dim": F.size("v"), "key": F.xxhash64("id", "v")})
    is_query = F.col("id") % every == 0
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("int")).alias("q")).collect()}  # a row a length
    blocks = lambda i, size: F.create_map(*[x for d, c in sizes.items() for x in (F.lit(d), F.lit(-(-(c[i] or 1) // size) or 1))])[F.col("dim")]
    if not sizes:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dealt = rows.withColumns({"nc": blocks(0, CANDIDATES), "nq": blocks(1, QUERIES)}).withColumns({"c": F.pmod("key", F.col("nc")).cast("int"), "q": F.pmod("key", F.col("nq")).cast("int")})
    dealt = common.cut(dealt)
    parts = ("dim", "c", "q", "is_query", "id", "key", "v", "m", "least")
    no_bound = F.lit(None).cast("long").alias("least")
    # a block of candidates meets every block of queries, and the other way round: blocks, not pairs of rows
    candidates = dealt.select("dim", "c", F.explode(F.sequence(F.lit(0), (F.col("nq") - 1).cast("int"))).alias("q"), F.lit(False).alias("is_query"), "id", "key", "v", "m", no_bound)
    queries = dealt.filter(is_query).select("dim", "nc", "q", F.lit(True).alias("is_query"), "id", "key", "v", "m")

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        col = lambda name: table.column(name).combine_chunks()
        ids, keys, mark, times = col("id").to_numpy(), col("key").to_numpy(), col("is_query").to_numpy(zero_copy_only=False), col("m").to_numpy()
        x = scaled(col("v").flatten().to_numpy().astype(np.float64).reshape(len(ids), dim), scale)
        a, b = np.flatnonzero(mark), np.flatnonzero(~mark)
        place = {(i, y): j for j, (i, y) in enumerate(zip(ids[b].tolist(), keys[b].tolist(), strict=True))}
        own = np.array([place.get(p, -1) for p in zip(ids[a].tolist(), keys[a].tolist(), strict=True)], np.int64)
        least = np.array([-np.inf if s is None else float(s) for s in col("least").take(pa.array(a)).to_pylist()])
        exact = x.dtype != object
        q, c, s = block_top(x[a], x[b].T, ids[b], np.minimum(times[b], k + 1), own, k, np.nextafter(least, -np.inf) if exact and np.isfinite(least).any() else None)
        return pa.table({"query_id": pa.array(ids[a][q]), "key": pa.array(keys[a][q]), "times": pa.array(times[a][q]), "vec_id": pa.array(ids[b][c]), "score": pa.array(s)})

    def searched(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        return candidates.select(*parts).union(queries.select(*parts)).groupBy("dim", "c", "q").applyInArrow(common.freeing(run), "query_id long, key long, times long, vec_id long, score long")

    start = searched(candidates.filter("c = 0"), queries.select("*", F.lit(0).alias("c"), no_bound))
    if any(-(-n // CANDIDATES) > 1 for n, _ in sizes.values()):
        start = common.cut(start)
        bounds = start.groupBy(F.col("query_id").alias("i"), F.col("key").alias("y")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
        bounded = queries.join(bounds, (F.col("id") == F.col("i")) & (F.col("key") == F.col("y")), "left").filter("nc > 1").withColumn("c", F.explode(F.sequence(F.lit(1), (F.col("nc") - 1).cast("int"))))
        start = start.union(searched(candidates.filter("c > 0"), bounded))
    best = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    found = start.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))  # rows that repeat are each a query
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"))


SQL = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), i as materialized (
  select r, vec_id, list_transform(e, lambda x: floor(256 * x)) as e from v
), s as (
  select q.r, q.vec_id as query_id, c.vec_id, case when len(q.e) = 0 then 0 else list_inner_product(q.e, c.e) end::bigint as score
  from i q join i c on q.vec_id % 50 = 0 and c.r <> q.r and len(c.e) = len(q.e)
)
select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 5
"""
