"""Projection and field shaping."""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import values as V
from weftline.registry import operator


@operator("add")
def add(df: DataFrame, **pairs) -> DataFrame:
    """add:PAIRS. Appends fields; an existing name gains further instances, a null adds nothing."""
    for name, v in pairs.items():
        c = V.value(df, v)
        if name not in df.columns:
            df = df.withColumn(name, c)
            continue
        old = F.col(name) if V.is_multi(df, name) else F.array_compact(F.array(name))
        df = df.withColumn(name, F.concat(F.coalesce(old, F.array()), F.array_compact(F.array(c))))
    return df


@operator("keep")
def keep(df: DataFrame, spec) -> DataFrame:
    """keep:FIELDS. Projects to fields; a negative list is an error, unknown names are ignored."""
    if isinstance(spec, str) and spec.startswith("-"):
        raise ValueError("keep takes no negative list; use rm")
    return df.select([c for c in V.fields(df, spec) if c in df.columns])


@operator("rm")
def rm(df: DataFrame, spec) -> DataFrame:
    """rm:FIELDS. Drops fields (a negative list: all but these)."""
    return df.drop(*V.fields(df, spec))


@operator("mv")
def mv(df: DataFrame, **pairs: str) -> DataFrame:
    """mv:PAIRS. Renames old=new; an old name @ref copies out the field that field ref names."""
    for old, new in pairs.items():
        if not old or not new:
            continue
        df = df.withColumnRenamed(old, new)
    return df


@operator("mv_ref")
def mv_ref(df: DataFrame, ref: str, new: str) -> DataFrame:
    """mv:@REF:NEW. The field whose name stands in REF becomes NEW; REF stays."""
    moved = V.indirect(df, ref)
    out = df.withColumn(new, moved)
    rest = {c: F.when(F.col(ref) == F.lit(c), F.lit(None)).otherwise(F.col(c)) for c in df.columns if c not in (ref, new) and not V.is_record(df, c) and not V.is_multi(df, c)}
    return out.withColumns(rest)


@operator("merge")
def merge(df: DataFrame, spec) -> DataFrame:
    """merge:FIELDS. All instances of each field, joined by a blank into one text."""
    made = {}
    for c in V.fields(df, spec):
        joined = F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ") if V.is_multi(df, c) else F.col(c).cast("string")
        made[c] = joined
    return df.withColumns(made)


@operator("flatten")
def flatten(df: DataFrame, spec) -> DataFrame:
    """flatten:SUBS. Fields of sub-records move into the parent; of repeated sub-records they repeat.

    Names that exist become multi-valued. A scalar SUB is dropped.
    """
    for sub in V.fields(df, spec):
        t = V.kind(df, sub)
        own = t.elementType if isinstance(t, T.ArrayType) else t
        if not isinstance(own, T.StructType):
            df = df.drop(sub)
            continue
        multi = isinstance(t, T.ArrayType)
        df = df.withColumnRenamed(sub, "__sub")
        for f in own.names:
            moved = _each("__sub", f) if multi else F.col("__sub")[f]
            if f not in df.columns:
                df = df.withColumn(f, moved)
            elif multi:
                old = F.col(f) if V.is_multi(df, f) else F.array_compact(F.array(f))
                df = df.withColumn(f, F.concat(F.coalesce(old, F.array()), F.coalesce(moved, F.array())))
            else:
                df = add(df, **{f: moved})
        df = df.drop("__sub")
    return df


def _each(rows: str, field: str) -> Column:
    return F.transform(F.col(rows), lambda x: x[field])


@operator("denorm")
def denorm(df: DataFrame, child: str, child_only: bool = False, keep_empty: bool = False) -> DataFrame:
    """denorm:CHILD. One row per child: the parent's other fields and the child's.

    Parents without children go unless keep_empty (ignored with child_only). A multi-valued scalar
    child gives a row per value. Child fields that clash with the parent's are suffixed _child.
    """
    multi = F.col(child) if V.is_multi(df, child) else F.array_compact(F.array(child))
    parents = [c for c in df.columns if c != child]
    explode = F.explode_outer if keep_empty and not child_only else F.explode
    out = df.select(*([] if child_only else parents), explode(multi).alias("__child"))
    if not V.is_record(df, child):
        return out.withColumnRenamed("__child", child)
    names = out.schema["__child"].dataType.names
    taken = set() if child_only else set(parents)
    return out.select(*([] if child_only else parents), *[F.col("__child")[n].alias(f"{n}_child" if n in taken else n) for n in names])


def _typed(c: Column, as_type: str | None) -> Column:
    c = F.when(c != "", c)
    return c if as_type in (None, "string") else c.try_cast(as_type)


def _group_numbers(pattern: str) -> dict[str, int]:
    """The number of each named group: opening brackets that capture, outside classes, quotes and escapes."""
    out, n = {}, 0
    for m in re.finditer(r"\\Q.*?(?:\\E|$)|\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern, re.S):
        if m.group()[0] == "(":
            n += 1
            if m.group(1):
                out[m.group(1)] = n
    return out


@operator("regex")
def regex(df: DataFrame, field: str, pattern: str, types: dict[str, str] | None = None, child: str = "child") -> DataFrame:
    """regex:INPUT:REGEX. Named groups become fields.

    A pattern anchored at either end adds to the parent from its first match; any other gives a `child`
    sub-record for each match. An optional group that does not match gives no value. types: SQL
    types of groups (a field has one type here, text unless said).
    """
    names = re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)
    text, types = V.as_text(df, field), types or {}
    number = _group_numbers(pattern)
    if pattern.startswith("^") or pattern.endswith("$"):
        return df.withColumns({n: _typed(F.regexp_extract(text, pattern, number[n]), types.get(n)) for n in names})
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(number[n])).alias(n) for n in names]
    zipped = F.arrays_zip(*parts)
    made = F.transform(zipped, lambda m: F.struct(*[_typed(m[n], types.get(n)).alias(n) for n in names]))
    return df.withColumn(child, F.when(F.size(parts[0]) > 0, made))


@operator("bin")
def bin_value(df: DataFrame, field: str, size: float) -> DataFrame:
    """bin:FIELD:BINSIZE. (long)(v / size) * size, truncated toward zero; long for sizes from 1 on, else double."""
    if size < 1e-9:
        raise ValueError("the bin size is below 1e-9")
    if not isinstance(V.kind(df, field), T.NumericType):
        return df
    n = (F.col(field) / F.lit(float(size))).try_cast("bigint")
    return df.withColumn(field, n * F.lit(int(size)) if size >= 1 and float(size).is_integer() else (n * F.lit(float(size))).cast("bigint") if size >= 1 else n * F.lit(float(size)))


@operator("hash")
def hash_fields(df: DataFrame, out: str, spec, mod: int = 0, wide: bool = False, seed: int = 0) -> DataFrame:
    """OUT=hash:INPUTS. XOR of a 64-bit hash of each value; 63 bits unless wide, reduced by mod from 2 on.

    The hash is xxhash64. Equal values cancel each other; a row without values, or without any of the fields, gets none.
    """
    names = [c for c in V.fields(df, spec) if c in df.columns]
    if not names:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    h = lambda c: F.xxhash64(F.lit(seed), c)
    parts = [F.aggregate(F.coalesce(F.col(c), F.array()), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(h(x))) if V.is_multi(df, c) else F.when(F.col(c).isNotNull(), h(F.col(c))).otherwise(F.lit(0)) for c in names]
    total = parts[0]
    for p in parts[1:]:
        total = total.bitwiseXOR(p)
    total = total if wide else total.bitwiseAND(F.lit((1 << 63) - 1))
    total = F.pmod(total, F.lit(mod)) if mod >= 2 else total
    return df.withColumn(out, F.when(F.coalesce(*names).isNotNull() if len({df.schema[c].dataType for c in names}) == 1 else F.greatest(*[F.col(c).isNotNull() for c in names]) if len(names) > 1 else F.col(names[0]).isNotNull(), total))


@operator("noOp")
def no_op(df: DataFrame) -> DataFrame:
    """noOp. Identity."""
    return df


@operator("throttle")
def throttle(df: DataFrame, per_second: int) -> DataFrame:
    """throttle:TPS. At most so many rows a second from all tasks that run at once, each with an equal share (the
    cluster's parallelism divides the rate); for calls to services that need it."""
    rate = per_second / max(1, df.sparkSession.sparkContext.defaultParallelism)
    step = max(1, int(rate))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, step):
                began = time.monotonic()
                part = b.slice(at, step)
                yield part
                time.sleep(max(0.0, part.num_rows / rate - (time.monotonic() - began)))

    return df.mapInArrow(run, df.schema)


@operator("rest")
def rest(df: DataFrame, endpoint: str, schema, batch_size: int = 30, nv2: bool = False) -> DataFrame:
    """rest://ENDPOINT. Posts batches of rows as JSON lines, or as nv2 text; the answer's records, in the same form,
    replace them. Fields outside `schema` are dropped, missing ones null; an answer in nv2 holds texts."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        import json
        import urllib.request

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from weftline.sources.formats import nv2_text, parse_nv2

        kind, arrow = ("text/plain" if nv2 else "application/x-ndjson"), to_arrow_schema(target)
        for b in batches:
            for at in range(0, b.num_rows, batch_size):
                rows = b.slice(at, batch_size).to_pylist()
                body = "".join(nv2_text(r) + "#\n" for r in rows) if nv2 else "\n".join(json.dumps(r, default=str) for r in rows)
                with urllib.request.urlopen(urllib.request.Request(endpoint, body.encode(), {"Content-Type": kind})) as answer:
                    text = answer.read().decode()
                found = [parse_nv2(x) for x in re.split(r"(?m)^#", text)] if nv2 else [json.loads(x) for x in text.splitlines() if x.strip()]
                if found := [r for r in found if r]:
                    yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return df.mapInArrow(run, target)
