"""Text operators, on white-space tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import values as V
from weftline.registry import operator


@operator("txtcount")
def txtcount(df: DataFrame, out: str, field: str) -> DataFrame:
    """OUT=txtcount:INPUT. Tokens of the first instance; a scalar that isn't text is one token."""
    t = V.kind(df, field)
    t = t.elementType if isinstance(t, T.ArrayType) else t
    c = V.first(df, field)
    return df.withColumn(out, F.when(c.isNotNull(), (F.regexp_count(c, F.lit(V.TOKEN)) if isinstance(t, T.StringType) else F.lit(1)).cast("bigint")))


@operator("txtsplit")
def txtsplit(df: DataFrame, spec, child: str = "term", with_field: bool = False) -> DataFrame:
    """txtsplit:INPUTS. Each token of the fields a `child` sub-record (text, and the field's name)."""

    def tokens_of(name: str):
        tokens = V.strip_tokens(F.col(name)) if isinstance(V.kind(df, name), T.StringType) else F.array_compact(F.array(V.as_text(df, name)))
        source = [F.lit(name).alias("field")] if with_field else []
        return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), *source))

    parts = [tokens_of(name) for name in V.fields(df, spec)]
    return df.withColumn(child, F.concat(*parts))


@operator("txtmatch")
def txtmatch(df: DataFrame, needle: str, haystack: str, min_match: str = "100%", add_type: bool = False) -> DataFrame:
    """txtmatch:NEEDLE:HAYSTACK. isMatch: whether enough tokens of NEEDLE are in HAYSTACK.

    min_match: a share (of tokens, rounded down), a list of least counts by NEEDLE's length (the last for longer ones),
    a type (broad, phrase or exact), or @FIELD, which holds one. exact is an equal text, phrase a part
    of it, broad all tokens; each also satisfies the weaker ones. add_type (with 100%) adds the type. Rows without a
    needle, or without a haystack, have no isMatch.
    """
    n, h = V.strip_tokens(F.col(needle)), V.strip_tokens(F.col(haystack))
    hits = F.size(F.filter(n, lambda t: F.array_contains(h, t)))
    size = F.size(n)
    full = hits >= size
    kind = F.when(full & (F.col(needle) == F.col(haystack)), "exact").when(full & F.contains(F.col(haystack), F.col(needle)), "phrase").when(full, "broad")
    rank = lambda c: F.when(c == "exact", 3).when(c == "phrase", 2).when(c == "broad", 1).otherwise(0)
    if min_match.startswith("@"):
        match = rank(kind) >= F.greatest(rank(F.col(min_match[1:])), F.lit(1))
    elif min_match in ("broad", "phrase", "exact"):
        match = rank(kind) >= rank(F.lit(min_match))
    elif min_match.endswith("%"):
        match = hits >= F.floor(size * float(min_match[:-1]) / 100)
    else:
        least = F.array(*[F.lit(int(x)) for x in min_match.split(",")])
        match = hits >= F.element_at(least, F.least(size, F.size(least)))
    given = F.col(needle).isNotNull() & F.col(haystack).isNotNull() & (size > 0)
    df = df.withColumn("isMatch", F.when(given, match))
    return df.withColumn("matchedType", F.when(given, kind)) if add_type else df
