"""Filters and conditionals; SQL's three values become two as each operator says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.registry import operator

Pipe = Callable[[DataFrame], DataFrame]


@operator("acceptIf")
def accept_if(df: DataFrame, cond) -> DataFrame:
    """acceptIf:COND. Keeps rows for which COND is true; null counts as false."""
    return df.filter(V.condition(df, cond))


@operator("rejectIf")
def reject_if(df: DataFrame, cond) -> DataFrame:
    """rejectIf:COND. Drops rows for which COND is true; null is kept."""
    return df.filter(~F.coalesce(V.condition(df, cond), F.lit(False)))


@operator("if")
def if_(df: DataFrame, cond, then: Pipe, otherwise: Pipe | None = None) -> DataFrame:
    """[ T else F if:COND. Runs one pipe on rows for which COND is true, the other (or none) on the rest.

    Either may give any number of rows and other columns; missing ones are null. The input is read
    once a branch; for branches that only set columns, `choose` reads it once.
    """
    c = F.coalesce(V.condition(df, cond), F.lit(False))
    return then(df.filter(c)).unionByName((otherwise or (lambda x: x))(df.filter(~c)), allowMissingColumns=True)


@operator("ifNot")
def if_not(df: DataFrame, cond, then: Pipe) -> DataFrame:
    """[ T ifNot:COND. Runs T on rows for which COND isn't true (null included)."""
    return if_(df, ~F.coalesce(V.condition(df, cond), F.lit(False)), then)


@operator("choose")
def choose(df: DataFrame, cond, then: dict[str, object], otherwise: dict[str, object] | None = None) -> DataFrame:
    """The conditional whose branches set columns: one pass, with CASE."""
    c, otherwise = F.coalesce(V.condition(df, cond), F.lit(False)), otherwise or {}
    made = {}
    for n in {**then, **otherwise}:
        old = F.col(n) if n in df.columns else F.lit(None)
        made[n] = F.when(c, V.value(df, then[n]) if n in then else old).otherwise(V.value(df, otherwise[n]) if n in otherwise else old)
    return df.withColumns(made)


def fields_subset_of(df: DataFrame, spec) -> Column:
    """True if a row has no other fields than these."""
    rest = [c for c in df.columns if c not in V.fields(df, spec)]
    out = F.lit(True)
    for c in rest:
        out = out & F.col(c).isNull()
    return out


def fields_superset_of(df: DataFrame, spec) -> Column:
    """True if a row has all these fields."""
    out = F.lit(True)
    for c in V.fields(df, spec):
        out = out & (F.col(c).isNotNull() if c in df.columns else F.lit(False))
    return out
