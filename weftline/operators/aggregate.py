"""Reducers, grouping and distinct rows.

A reducer is an aggregate column under a name. `reduce` gives the result of a whole table,
`summarize` that of each key: the rewrite of grouping rows and then reducing each group, which
gathers no rows. Inside `foreach` the same reducers fold an array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import values as V
from weftline.operators.keyed import first_per_key
from weftline.registry import operator


@dataclass(frozen=True)
class Reducer:
    """kind: count, sum, or, and, txtcat; of: what it reads."""

    kind: str
    of: object = None
    as_long: bool = False

    def over_rows(self, df: DataFrame) -> Column:
        """As an aggregate over the rows of `df`."""
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind == "sum":
            total = _total(_number(df, self.of))
            return F.round(total).cast("bigint") if self.as_long else total
        if self.kind in ("or", "and"):
            fold, start = (F.bool_or, False) if self.kind == "or" else (F.bool_and, True)
            return F.coalesce(fold(V.condition(df, self.of)), F.lit(start))
        names = V.fields(df, self.of)
        text = F.array_join(F.flatten(F.array(*[F.transform(F.col(c), lambda x: x.cast("string")) if V.is_multi(df, c) else F.array_compact(F.array(F.col(c).cast("string"))) for c in names])), " ")
        return F.array_join(F.array_sort(F.collect_list(F.when(text != "", text))), " ")

    def over_children(self, df: DataFrame, child: str) -> Column:
        """As a fold over the children of each row of `df`."""
        rows = V.records(df, child) if V.is_record(df, child) else F.coalesce(F.col(child) if V.is_multi(df, child) else F.array_compact(F.array(child)), F.array())
        if self.kind == "count":
            return F.size(rows).cast("bigint")
        of = self.of if callable(self.of) else (lambda x: x[self.of] if V.is_record(df, child) else F.lit(self.of)) if isinstance(self.of, str) else (lambda x: F.lit(self.of))
        if self.kind == "sum":
            total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.coalesce(of(x).cast("double"), F.lit(0.0)))
            return F.round(total).cast("bigint") if self.as_long else total
        if self.kind == "or":
            return F.coalesce(F.exists(rows, lambda x: F.coalesce(of(x), F.lit(False))), F.lit(False))
        if self.kind == "and":
            return F.coalesce(F.forall(rows, lambda x: F.coalesce(of(x), F.lit(True))), F.lit(True))
        return F.array_join(F.transform(rows, lambda x: of(x).cast("string")), " ")


def _total(x: Column) -> Column:
    """The sum of doubles, 0.0 of nothing. Six decimals are added exactly and what is left of a value apart, so that
    sums of amounts depend neither on the order of rows nor on partitions; values of 1e12 or more are left whole."""
    exact = x.try_cast("decimal(18,6)")
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(x - F.coalesce(exact.cast("double"), F.lit(0.0))), F.lit(0.0))


def _number(df: DataFrame, v) -> Column:
    if isinstance(v, str) and v in df.columns:
        if V.is_multi(df, v):
            return F.aggregate(F.coalesce(F.col(v), F.array()), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
        return V.as_double(df, v)
    return V.value(df, v).cast("double")


@operator("recCount", "reducer")
def rec_count() -> Reducer:
    """OUT=recCount. Counts rows."""
    return Reducer("count")


@operator("sum", "reducer")
def sum_of(v, as_long: bool = False) -> Reducer:
    """OUT=sum:VALUE. Sum as double (0.0 of nothing); a literal adds a constant per row; as_long rounds."""
    return Reducer("sum", v, as_long)


@operator("or", "reducer")
def any_of(v) -> Reducer:
    """OUT=or:VALUE. Whether VALUE is ever true; false of nothing, what isn't boolean is ignored."""
    return Reducer("or", v)


@operator("and", "reducer")
def all_of(v) -> Reducer:
    """OUT=and:VALUE. Whether VALUE is never false; true of nothing, what isn't boolean is ignored."""
    return Reducer("and", v)


@operator("txtcat", "reducer")
def txtcat(spec) -> Reducer:
    """OUT=txtcat:INPUTS. All instances as one text, by blanks, in ascending order of the rows' texts."""
    return Reducer("txtcat", spec)


@operator("reduce")
def reduce_all(df: DataFrame, **reducers: Reducer) -> DataFrame:
    """The results of reducers over a whole table, as one row (REDUCE)."""
    return df.agg(*[r.over_rows(df).alias(n) for n, r in reducers.items()])


@operator("summarize")
def summarize(df: DataFrame, keys, **reducers: Reducer) -> DataFrame:
    """Group and reduce: a row per key with the reducers' results."""
    return df.groupBy(*V.fields(df, keys)).agg(*[r.over_rows(df).alias(n) for n, r in reducers.items()])


class Reductions:
    """Results of reducers amid a pipeline, by instance; each is there once a job has run the rows it observes."""

    def __init__(self) -> None:
        self._found: dict[str, Callable[[], list]] = {}
        self._schemas: dict[str, T.StructType] = {}

    def put(self, instance: str, schema: T.StructType, values: Callable[[], list]) -> None:
        if instance in self._found:
            raise ValueError(f"two reducers named {instance}")
        self._found[instance], self._schemas[instance] = values, schema

    def rows(self, spark: SparkSession, instances: str | list[str] | None = None, pipe: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """REDUCE[:INSTANCES] EXP. A row an instance (all, if none are named), missing fields null, through `pipe`."""
        names = list(self._found) if instances is None else [s.strip() for s in (instances.split(",") if isinstance(instances, str) else instances)]
        made = [spark.createDataFrame([tuple(self._found[n]())], self._schemas[n]).select(F.lit(n).alias("instance"), "*") for n in names]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made) if made else spark.createDataFrame([], "instance string")
        return pipe(out) if pipe else out


def observed(df: DataFrame, name: str, **reducers: Reducer):
    """(`df` unchanged, an Observation of the reducers' results that fills as `df` is run)."""
    seen = Observation(name)
    return df.observe(seen, *[r.over_rows(df).alias(n) for n, r in reducers.items()]), seen


@operator("observe")
def observe(df: DataFrame, instance: str, into: Reductions, **reducers: Reducer) -> DataFrame:
    """The rows unchanged; the reducers' results over them come to `into` as the job runs, without a job of their own."""
    seen, columns = Observation(), [r.over_rows(df).alias(n) for n, r in reducers.items()]
    schema = df.agg(*columns).schema
    into.put(instance, schema, lambda: [seen.get[n] for n in schema.names])
    return df.observe(seen, *columns)


@operator("uniq")
def uniq(df: DataFrame, spec, count: str | None = None, retain_others: bool = False, order_by: list | None = None) -> DataFrame:
    """uniq:INPUTS. Distinct key fields; count names a field for the occurrences; retain_others keeps the first whole row."""
    keys = V.fields(df, spec)
    if not retain_others:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)) if count else df.select(*keys).distinct()
    if order_by is not None:
        out = df.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if count else df
        return first_per_key(out, keys, order_by)
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.min(F.struct(*rest)).alias("__first")] if rest else []
    out = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias(count or "__n"))
    return out.select(*[c if c in keys else F.col(f"__first.{c}") for c in df.columns], *([count] if count else []))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)
