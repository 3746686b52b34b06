"""Sorting, limits, samples and concatenation. Orders are explicit, for Spark has none otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.registry import operator

_TYPES = {"l": "bigint", "d": "double", "s": "string"}


def order_of(df: DataFrame, specs) -> list[Column]:
    """SPECS ({+-}{l,d,s}.FIELD, comma-separated or a list) as columns; missing values first, last when descending."""
    out = []
    for s in specs.split(",") if isinstance(specs, str) else specs:
        down, rest = s.startswith("-"), s.lstrip("+-")
        as_type, name = rest.split(".", 1) if "." in rest and rest.split(".", 1)[0] in _TYPES else (None, rest)
        c = F.col(name).try_cast(_TYPES[as_type]) if as_type else F.col(name)
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out


@operator("sort")
def sort(df: DataFrame, specs, uniq_by: str | None = None, uniq_count: int = 1) -> DataFrame:
    """sort:SPECS. With uniq_by, the first uniq_count rows of each value of that field, in this order.

    uniq_by has to lead the order (runs of equal values are then groups).
    """
    order = order_of(df, specs)
    if uniq_by:
        lead = (specs.split(",") if isinstance(specs, str) else specs)[0].lstrip("+-").split(".")[-1]
        if lead != uniq_by:
            raise ValueError("uniq_by has to be the first field of the order")
        rank = F.row_number().over(Window.partitionBy(uniq_by).orderBy(*order))
        df = df.withColumn("__rank", rank).filter(F.col("__rank") <= uniq_count).drop("__rank")
    return df.orderBy(*order)


@operator("head")
def head(df: DataFrame, n: int, specs=None) -> DataFrame:
    """head:MAX. The first rows of an order, any rows without one; -1 is all."""
    df = df.orderBy(*order_of(df, specs)) if specs else df
    return df if n < 0 else df.limit(n)


@operator("tail")
def tail(df: DataFrame, n: int, specs) -> DataFrame:
    """tail:MAX. The last rows of an order."""
    turned = [s[1:] if s.startswith("-") else "-" + s.lstrip("+") for s in (specs.split(",") if isinstance(specs, str) else specs)]
    last = df.orderBy(*order_of(df, turned)).limit(n)
    return last.orderBy(*order_of(last, specs))


@operator("sample")
def sample(df: DataFrame, spec: int | float, seed: int = 0, by: str | None = None) -> DataFrame:
    """sample:SPEC. An integer: exactly so many rows; a float: each row with that probability (1.0: all). by: a key
    whose hash with the seed decides, so that the same rows are drawn however the table is laid out."""
    key = None if by is None else F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(by).cast("string")).cast("binary"))
    if isinstance(spec, float):
        if not 0 <= spec <= 1:
            raise ValueError("a share is between 0 and 1")
        return df.sample(spec, seed) if key is None else df.filter(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") < F.lit(spec * (1 << 32)))
    return df.orderBy(F.rand(seed) if key is None else key).limit(spec)


@operator("cat")
def cat(*dfs: DataFrame) -> DataFrame:
    """cat:N. All rows of the sources, missing fields null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


@operator("fanout")
def fanout(df: DataFrame, n: int) -> DataFrame:
    """Repeats each row n times."""
    return df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("__i")
