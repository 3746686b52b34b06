"""Field statistics and divergence, from histograms that Spark aggregates."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import values as V
from weftline.operators.shape import bin_value
from weftline.registry import operator

PERCENTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}
BUCKETS = 4096


def histogram(df: DataFrame, field: str, double_bin: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n) of a field's instances; doubles are binned first."""
    by = by or []
    if V.is_multi(df, field):
        df = df.select(*by, F.explode(field).alias(field))
    if isinstance(V.kind(df, field), (T.DoubleType, T.FloatType)):
        df = bin_value(df, field, double_bin)
    return df.filter(F.col(field).isNotNull()).groupBy(*by, F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@operator("statsOf")
def stats_of(df: DataFrame, spec, max_points: int = 10, min_count: int = 1, double_bin: float = 0.01, sub_stats_by: str | None = None) -> DataFrame:
    """statsOf:INPUTS. A row per field: row, value and distinct counts, for numbers also sum, mean, max, min,
    population deviation and percentiles, and the `max_points` most frequent values of min_count or more.

    A percentile p is the value at place floor(p * N) from 0. With sub_stats_by, also a row per value
    of that field, named input_value.
    """
    out = None
    for field in V.fields(df, spec):
        one = _stats(df.withColumn("__by", F.lit(field)), field, "__by", max_points, min_count, double_bin)
        out = one if out is None else out.unionByName(one)
        if sub_stats_by:
            named = df.filter(F.col(sub_stats_by).isNotNull()).withColumn("__by", F.concat(F.lit(f"{field}_"), F.col(sub_stats_by).cast("string")))
            out = out.unionByName(_stats(named, field, "__by", max_points, min_count, double_bin))
    return out.withColumnRenamed("__by", "field")


def _stats(df: DataFrame, field: str, by: str, max_points: int, min_count: int, double_bin: float) -> DataFrame:
    t = V.kind(df, field)
    t = t.elementType if isinstance(t, T.ArrayType) else t
    number = isinstance(t, T.NumericType)
    h = histogram(df, field, double_bin, [by])
    points = h.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value")))  # limited in each task first
    points = points.filter((F.col("__rank") <= max_points) & (F.col("n") >= min_count)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__rank", F.col("value").cast("string").alias("value"), "n"))).alias("p"))
    points = points.select(by, F.transform("p", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("points"))
    v, n = F.col("value").cast("double"), F.col("n")
    aggs = [F.sum("n").alias("num_values"), F.count(F.lit(1)).alias("num_unique")]
    if number:
        aggs += [F.sum(v * n).alias("sum"), (F.sum(v * n) / F.sum("n")).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min")]
        found = h.groupBy(by).agg(*aggs)
        near = h.join(found, by)
        spread = near.groupBy(by).agg(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum("n")).alias("stdev"))
        found = found.join(spread, by).join(_percentiles(near, by), by)
    else:
        found = h.groupBy(by).agg(*aggs, *[F.lit(None).cast("double").alias(k) for k in ("sum", "mean", "max", "min", "stdev", *PERCENTILES)])
    have = F.size(field) > 0 if V.is_multi(df, field) else F.col(field).isNotNull()
    rows = df.groupBy(by).agg(F.sum(F.when(have, 1).otherwise(0)).cast("bigint").alias("num_recs"))
    return rows.join(found, by).join(points, by, "left")


def _percentiles(h: DataFrame, by: str) -> DataFrame:
    """(by, the percentiles) of a histogram with its totals. Counts are summed up over at most `BUCKETS` buckets of
    equal width; only the buckets that hold a percentile are then looked at value by value, each by itself."""
    v, width = F.col("value").cast("double"), F.col("max") - F.col("min")
    h = h.withColumn("__bucket", F.when(width > 0, F.least(F.floor((v - F.col("min")) / width * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0))
    buckets = h.groupBy(by, "__bucket", "num_values").agg(F.sum("n").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0))
    place = lambda p: F.floor(F.lit(p) * F.col("num_values"))
    buckets = buckets.withColumns({"__before": upto - F.col("__n"), "__upto": upto})
    holds = reduce(or_, [(F.col("__before") <= place(p)) & (place(p) < F.col("__upto")) for p in PERCENTILES.values()])
    inside = h.join(buckets.filter(holds).select(by, "__bucket", "__before"), [by, "__bucket"])
    within = Window.partitionBy(by, "__bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__upto", F.col("__before") + F.sum("n").over(within))
    return inside.groupBy(by).agg(*[F.min(F.when(F.col("__upto") > place(p), v)).alias(k) for k, p in PERCENTILES.items()])


@operator("divergence")
def divergence(left: DataFrame, right: DataFrame, max_points: int | None = None) -> DataFrame:
    """divergence:STATS. From two histograms (value, n): entropies, cross-entropy of right against left, the
    cross-entropy less the left entropy (`kl`, as such tools print it) and the true `kl_right_left`; base 2.

    A value that left lacks counts there as 1 / number of left's values. max_points keeps the most frequent only.
    """
    cut = lambda h: h if max_points is None else h.orderBy(F.desc("n"), "value").limit(max_points)
    total = lambda h: h.agg(F.sum("n").alias("t"))
    left, right = cut(left), cut(right)
    lp = left.join(F.broadcast(total(left))).select("value", (F.col("n") / F.col("t")).alias("p"), "t")  # one row is sent
    rp = right.join(F.broadcast(total(right))).select("value", (F.col("n") / F.col("t")).alias("q"))
    entropy = lambda d, c, name: d.agg((-F.sum(F.col(c) * F.log2(c))).alias(name))
    unseen = F.broadcast(left.agg((1 / F.sum("n")).alias("unseen")))
    cross = rp.join(lp, "value", "left").join(unseen).agg((-F.sum(F.col("q") * F.log2(F.coalesce("p", "unseen")))).alias("cross_entropy"))
    out = entropy(lp, "p", "left_entropy").join(entropy(rp, "q", "right_entropy")).join(cross)  # one row each
    return out.withColumns({"kl": F.col("cross_entropy") - F.col("left_entropy"), "kl_right_left": F.col("cross_entropy") - F.col("right_entropy")})
