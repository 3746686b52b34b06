"""Keyed operands, joins and filters by key.

The right side is reduced to one row per key, so a join never multiplies left rows. Null keys equal
each other. Equi-joins are left to Spark, which picks broadcast or sort-merge by size and splits
skewed partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.registry import operator


@dataclass(frozen=True)
class Keyed:
    """A DataFrame with at most one row per key."""

    df: DataFrame
    keys: list[str]


def first_per_key(df: DataFrame, keys: list[str], order_by: list | None = None) -> DataFrame:
    """One row per key: the first in the given order, by default of all columns ascending.

    As an aggregate of the least row, so it combines before the shuffle and no key is a window.
    """
    if order_by is None:
        rest = [c for c in df.columns if c not in keys]
        if not rest:
            return df.distinct()
        return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__first")).select(*keys, "__first.*").select(df.columns)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


@operator("map", "keyed")
def map_by(df: DataFrame, keys, order_by: list | None = None) -> Keyed:
    """map:KEYS. One (the first) row per key; as a source, its rows."""
    keys = V.fields(df, keys)
    return Keyed(first_per_key(df, keys, order_by), keys)


@operator("group", "keyed")
def group_by(df: DataFrame, keys, child: str = "child", order: bool = True) -> Keyed:
    """group:KEYS. The key fields and all other fields' rows as sub-records `child`, in order of their values.

    A group is a row and has to fit in one; to aggregate, use `summarize`, which gathers nothing.
    """
    keys = V.fields(df, keys)
    rows = F.collect_list(F.struct(*[c for c in df.columns if c not in keys]))
    return Keyed(df.groupBy(*keys).agg((F.array_sort(rows) if order else rows).alias(child)), keys)


def _right(right: Keyed, left: DataFrame, collision: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(right side under private names, [(own name, private name)] of its non-key fields)."""
    names = [(c, f"__r_{c}") for c in right.df.columns]
    out = right.df.select(*[F.col(c).alias(p) for c, p in names])
    return out, [(c, p) for c, p in names if c not in right.keys]


@operator("join")
def join(left: DataFrame, right: Keyed, how: str = "left", collision: str = "suffix") -> DataFrame:
    """join:HOW. left, inner, right, outer; any other word adds that boolean field: whether the key exists.

    collision, for non-key fields that both sides have: "suffix" (the right one ends in _right), "array" (both
    as instances of one field) or "left" (the left one).
    """
    if how in ("+", "-", "once", "+diff"):
        raise ValueError(f"{how} is a word of filter")
    r, rest = _right(right, left, collision)
    on = None
    for k in right.keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = c if on is None else on & c
    if how not in ("left", "inner", "right", "outer"):
        marked = r.select(*[f"__r_{k}" for k in right.keys]).withColumn("__hit", F.lit(True))
        return left.join(marked, on, "left").select(*left.columns, F.coalesce("__hit", F.lit(False)).alias(how))
    out = left.withColumn("__l", F.lit(True)).join(r, on, {"outer": "full"}.get(how, how))
    cols = []
    for c in left.columns:
        if c in right.keys:
            cols.append(F.when(F.col("__l"), F.col(c)).otherwise(F.col(f"__r_{c}")).alias(c) if how in ("right", "outer") else F.col(c))
        elif collision == "array" and c in dict(rest):
            cols.append(F.array_compact(F.array(F.col(c), F.col(f"__r_{c}"))).alias(c))
        else:
            cols.append(F.col(c))
    for c, p in rest:
        if c not in left.columns:
            cols.append(F.col(p).alias(c))
        elif collision == "suffix":
            cols.append(F.col(p).alias(f"{c}_right"))
    return out.select(*cols)


@operator("filter")
def filter_by(left: DataFrame, right: Keyed, how: str = "+") -> DataFrame:
    """filter:HOW. + semi-join, - anti-join, once semi-join with the first left row per key only,
    +diff the key and LEFT and RIGHT records of the fields that differ."""
    r, rest = _right(right, left, "suffix")
    on = None
    for k in right.keys:
        c = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = c if on is None else on & c
    if how == "+":
        return left.join(r, on, "left_semi")
    if how == "-":
        return left.join(r, on, "left_anti")
    if how == "once":
        return first_per_key(left.join(r, on, "left_semi"), right.keys)
    if how != "+diff":
        raise ValueError(f"{how} is no word of filter")
    names = sorted({c for c in left.columns if c not in right.keys} | {c for c, _ in rest})
    kinds = {**dict(right.df.dtypes), **dict(left.dtypes)}
    l_of = lambda c: F.col(c) if c in left.columns else F.lit(None).cast(kinds[c])
    r_of = lambda c: F.col(f"__r_{c}") if c in dict(rest) else F.lit(None).cast(kinds[c])
    differ = {c: ~l_of(c).eqNullSafe(r_of(c)) for c in names}
    side = lambda of: F.struct(*[F.when(differ[c], of(c)).alias(c) for c in names])
    any_differ = F.lit(False)
    for c in names:
        any_differ = any_differ | differ[c]
    return left.join(r, on, "inner").filter(any_differ).select(*right.keys, side(l_of).alias("LEFT"), side(r_of).alias("RIGHT"))
