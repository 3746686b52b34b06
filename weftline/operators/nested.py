"""Work on the sub-records of each row: folds and maps of arrays where they suffice, else by row ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.operators.aggregate import Reducer
from weftline.registry import operator


@operator("foreach")
def foreach(df: DataFrame, child: str, *, where: Callable[[Column], Column] | None = None, set_fields: dict[str, Callable[[Column], Column]] | None = None, sort: list[str] | None = None, head: int | None = None, tail: int | None = None, unique: bool = False, **reducers: Reducer) -> DataFrame:
    """[ EXP foreach:CHILD. Per row: filter, set fields of, sort, cut and reduce its children.

    In this order; sort takes field names, with a leading - for descending; head and tail take the first and last
    so many. Reducers' results are fields of the parent. All of it stays inside the row, without a shuffle.
    """
    rows = V.records(df, child) if V.is_record(df, child) else F.coalesce(F.col(child) if V.is_multi(df, child) else F.array_compact(F.array(child)), F.array())
    if where is not None:
        rows = F.filter(rows, lambda x: F.coalesce(where(x), F.lit(False)))
    if set_fields:

        def changed(x: Column) -> Column:
            for n, f in set_fields.items():
                x = x.withField(n, f(x))
            return x

        rows = F.transform(rows, changed)
    if unique:
        rows = F.array_distinct(rows)
    for key in reversed(sort or []):
        rows = _sorted(rows, key)
    if head is not None and head >= 0:
        rows = F.slice(rows, 1, head) if head else F.slice(rows, 1, 0)
    if tail is not None and tail >= 0:
        rows = F.reverse(F.slice(F.reverse(rows), 1, tail))
    df = df.withColumn(child, rows)
    return df.withColumns({n: r.over_children(df, child) for n, r in reducers.items()})


def _sorted(rows: Column, key: str) -> Column:
    down, name = key.startswith("-"), key.lstrip("+-")

    def compare(a: Column, b: Column) -> Column:
        x, y = (b[name], a[name]) if down else (a[name], b[name])
        return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return F.array_sort(rows, compare)


@operator("foreach_pipe")
def foreach_pipe(df: DataFrame, child: str, pipe: Callable[[DataFrame], DataFrame], id_cols: list[str]) -> DataFrame:
    """[ EXP foreach:CHILD with any pipe, joins included: children become rows, pass it, and come back.

    id_cols identify a row. The pipe sees them, the parent's other fields and the child's (the parent's
    first), and must keep id_cols; the fields that are not the parent's come back as children.
    """
    parents = [c for c in df.columns if c != child]
    names = df.select(F.explode(child).alias("c")).schema["c"].dataType.names
    rows = df.select(*parents, F.posexplode(child).alias("__pos", "__c")).select(*parents, "__pos", *[F.col(f"__c.{n}") for n in names if n not in parents])
    out = pipe(rows)
    back = out.groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("__pos", *[c for c in out.columns if c not in parents and c != "__pos"]))).alias("__rows"))
    own = df.drop(child).join(back, id_cols, "left")
    fields = [c for c in out.columns if c not in parents and c != "__pos"]
    return own.withColumn(child, F.transform("__rows", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).drop("__rows")


@operator("inject")
def inject(df: DataFrame, child: str = "child", only=None, exclude=None, **kwargs) -> DataFrame:
    """[ EXP inject. Feeds the row itself (or some fields) to EXP, whose outputs become `child` sub-records."""
    names = V.fields(df, only) if only else [c for c in df.columns if not exclude or c not in V.fields(df, exclude)]
    return foreach(df.withColumn(child, F.array(F.struct(*names))), child, **kwargs)
