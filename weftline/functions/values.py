"""Values, typed accessors and field lists.

A field that occurs once is a scalar column; one that repeats is an array column, a sub-record a
struct or an array of structs. VALUE arguments are Spark SQL expressions (or Columns); a name with
a leading @ takes the name of the field from another field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of ASCII white space, the separators of text tokens.
BLANKS = r"[ \t\n\x0B\f\r\x1C-\x1F]+"
#: What BLANKS part.
TOKEN = r"[^ \t\n\x0B\f\r\x1C-\x1F]+"


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_multi(df: DataFrame, name: str) -> bool:
    return isinstance(kind(df, name), T.ArrayType)


def is_record(df: DataFrame, name: str) -> bool:
    t = kind(df, name)
    return isinstance(t, T.StructType) or (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType))


def first(df: DataFrame, name: str) -> Column:
    """The first instance of a field."""
    return F.get(F.col(name), F.lit(0)) if is_multi(df, name) else F.col(name)


def records(df: DataFrame, name: str) -> Column:
    """A sub-record field as an array; null as an empty one."""
    c = F.col(name) if is_multi(df, name) else F.when(F.col(name).isNotNull(), F.array(name))
    return F.coalesce(c, F.array().cast(T.ArrayType(kind(df, name).elementType if is_multi(df, name) else kind(df, name))))


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric columns widened, null for any other type."""
    t = kind(df, name)
    t = t.elementType if isinstance(t, T.ArrayType) else t
    return first(df, name).cast("double") if isinstance(t, T.NumericType) else F.lit(None).cast("double")


def as_long(df: DataFrame, name: str) -> Column:
    """Numeric columns truncated toward zero, null for any other type."""
    t = kind(df, name)
    t = t.elementType if isinstance(t, T.ArrayType) else t
    return first(df, name).try_cast("bigint") if isinstance(t, T.NumericType) else F.lit(None).cast("bigint")


def as_boolean(df: DataFrame, name: str) -> Column:
    t = kind(df, name)
    t = t.elementType if isinstance(t, T.ArrayType) else t
    return first(df, name) if isinstance(t, T.BooleanType) else F.lit(None).cast("boolean")


def as_text(df: DataFrame, name: str, precision: int | None = None) -> Column:
    """Any scalar as text; doubles in full, or with `precision` decimals."""
    c, t = first(df, name), kind(df, name)
    t = t.elementType if isinstance(t, T.ArrayType) else t
    if precision is not None and isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), F.format_string(f"%.{precision}f", c))
    return c.cast("string")


def strip_tokens(text: Column) -> Column:
    """The non-empty tokens of a text."""
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def value(df: DataFrame, v) -> Column:
    """A VALUE argument as a column: a Column, a literal, @field (indirect), or a SQL expression."""
    if isinstance(v, Column):
        return v
    if not isinstance(v, str):
        return F.lit(v)
    if v.startswith("@"):
        return indirect(df, v[1:])
    return F.expr(v)


def indirect(df: DataFrame, name: str) -> Column:
    """The field whose name stands in field `name`, as text; null where there is no such field."""
    pairs = [(F.col(name) == F.lit(c), F.col(c).cast("string")) for c in df.columns if c != name and not is_record(df, c) and not is_multi(df, c)]
    return reduce(lambda acc, p: F.when(p[0], p[1]).otherwise(acc), pairs, F.lit(None).cast("string"))


def condition(df: DataFrame, v) -> Column:
    """A condition: what isn't boolean is null."""
    c = indirect(df, v[1:]).try_cast("boolean") if isinstance(v, str) and v.startswith("@") and not isinstance(kind(df, v[1:]), T.BooleanType) else F.col(v[1:]) if isinstance(v, str) and v.startswith("@") else value(df, v)
    is_bool = isinstance(df.select(c.alias("c")).schema["c"].dataType, T.BooleanType)
    return c if is_bool else F.lit(None).cast("boolean")


def fields(df: DataFrame, spec: str | list[str], among: list[str] | None = None) -> list[str]:
    """A field list: names, comma-separated; + all, pre+ and +suf wildcards, a leading - for all but these."""
    among = df.columns if among is None else among
    names = [s.strip() for s in (spec.split(",") if isinstance(spec, str) else spec)]
    drop = bool(names) and names[0].startswith("-")
    if drop:
        names = [names[0][1:], *names[1:]]
    found: list[str] = []
    for n in names:
        if n == "+":
            found += among
        elif n.endswith("+"):
            found += [c for c in among if c.startswith(n[:-1])]
        elif n.startswith("+"):
            found += [c for c in among if c.endswith(n[1:])]
        elif n:
            found.append(n)
    found = list(dict.fromkeys(found))
    return [c for c in among if c not in found] if drop else found
