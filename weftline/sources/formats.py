"""Readers and writers of file formats. Text formats are read by Spark's text source, a record a row,
and parsed in tasks; gzip and bzip2 by extension."""

from __future__ import annotations

import json
import os
import re
import zlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import values as V
from weftline.operators.aggregate import Reductions
from weftline.registry import operator

# --- types of text values -------------------------------------------------------------------------


def type_of(text: str) -> str:
    """long, double, boolean or string: the type that a text value has by itself."""
    if re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return "bigint"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) and re.search(r"[.eE]", text) and abs(float(text)) != float("inf"):
        return "double"
    return "boolean" if text.lower() in ("true", "false") else "string"


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Types by the codes of their values, or-ed; other mixtures stay text.
_KINDS = {1: "bigint", 2: "double", 3: "double", 4: "boolean"}


def _code(c: Column) -> Column:
    is_long = c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()
    is_double = c.rlike(_NUMBER) & c.rlike("[.eE]") & (F.abs(c.try_cast("double")) < float("inf"))
    return F.when(c.isNull(), None).when(is_long, 1).when(is_double, 2).when(F.lower(c).isin("true", "false"), 4).otherwise(8)


def infer(df: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Text columns with one type each, inferred over all rows; long and double widen to double, other
    mixtures stay text. declared: types given by the user."""
    declared = declared or {}
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in declared]
    if names:
        row = df.agg(*[F.bit_or(_code(F.col(n))).alias(n) for n in names]).first()
        declared = {**{n: _KINDS[row[n]] for n in names if row[n] in _KINDS}, **declared}
    return df.withColumns({n: F.col(n).try_cast(t) for n, t in declared.items() if n in df.columns})


def _chosen(spark: SparkSession, path: str, allow_missing: bool = False, valid_regex: str | None = None) -> str | list[str]:
    """The path, or those of its files that match; nothing where it may be missing and is."""
    if not (allow_missing or valid_regex):
        return path
    files = _files(spark, path)
    if not files and not allow_missing:
        raise FileNotFoundError(path)
    return [f for f in files if not valid_regex or re.search(valid_regex, f)]


def _lines(spark: SparkSession, path: str, sep: str | None = None, allow_missing: bool = False, valid_regex: str | None = None) -> DataFrame:
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    paths = _chosen(spark, path, allow_missing, valid_regex)
    return reader.text(paths) if paths else spark.createDataFrame([], "value string")


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path with its scheme and from the root."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    return fs, fs.makeQualified(where).toString()


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or pattern stands for, in any store that Spark reads."""
    (fs, _), found = _hadoop(spark, path), []
    for top in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)) or []:
        for f in fs.listStatus(top.getPath()) if top.isDirectory() else [top]:
            if f.isFile() and f.getPath().getName()[0] not in "._":
                found.append(f.getPath().toString())
    return sorted(found)


#: Where a row stands: its file, the beginning of the part of the file that a task reads, and the place in that.
_PLACE = {"__file": F.input_file_name, "__from": F.input_file_block_start, "__at": F.monotonically_increasing_id}


def with_errors_allowed(df: DataFrame, bad, allow_errors: int) -> DataFrame:
    """Rows of `df` under the rule for errors: with 0 the first bad row fails the job; with N a file's first
    N - 1 bad rows are skipped and its rest, from the Nth on, is left out.

    Only the bad rows are ranked; the place of the Nth of each file that has one is joined to the rows."""
    if allow_errors <= 0:
        return df.filter(F.when(bad, F.raise_error(F.lit("bad record")).cast("boolean")).otherwise(True))
    placed = df.withColumns({n: f() for n, f in _PLACE.items() if n not in df.columns}).withColumn("__bad", F.coalesce(bad, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("__file").orderBy("__from", "__at"))
    ends = placed.filter("__bad").select("__file", "__from", "__at").withColumn("__n", rank).filter(F.col("__n") == allow_errors)
    ends = ends.select(F.col("__file").alias("__ended"), F.struct("__from", "__at").alias("__end"))
    rows = placed.join(ends, F.col("__file") == F.col("__ended"), "left")
    return rows.filter(~F.col("__bad") & (F.col("__end").isNull() | (F.struct("__from", "__at") < F.col("__end")))).select(*[c for c in df.columns if c not in _PLACE])


# --- nv2 ------------------------------------------------------------------------------------------


def parse_nv2(text: str) -> dict | None:
    """One record: name:value lines, a tab for each level; an empty value before deeper lines is a sub-record."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return None

    def level(line: str) -> int:
        return len(line) - len(line.lstrip("\t"))

    def block(at: int, depth: int) -> tuple[dict, int]:
        rec: dict[str, list] = {}
        while at < len(lines) and level(lines[at]) == depth:
            name, found, v = lines[at].strip("\t").partition(":")
            if not found:
                raise ValueError(f"no colon in {lines[at]!r}")
            if not v and at + 1 < len(lines) and level(lines[at + 1]) > depth:
                sub, at = block(at + 1, depth + 1)
                rec.setdefault(name, []).append(sub)
            else:
                rec.setdefault(name, []).append(v)
                at += 1
        if at < len(lines) and level(lines[at]) > depth:
            raise ValueError(f"line too deep: {lines[at]!r}")
        return {k: v[0] if len(v) == 1 else v for k, v in rec.items()}, at

    return block(level(lines[0]), level(lines[0]))[0]


def _from_json(df: DataFrame, schema, declared: dict[str, str] | None) -> DataFrame:
    """Rows of JSON text (column value) as columns: by `schema`, or inferred."""
    if schema is not None:
        return df.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")
    # Spark infers a schema from JSON texts only as an RDD; the rows themselves stay a DataFrame
    found = df.sparkSession.read.option("primitivesAsString", "true").json(df.select("value").rdd.map(lambda r: r[0])).schema
    return infer(df.select(F.from_json("value", found).alias("r")).select("r.*"), declared)


@operator("nv2", "source")
def read_nv2(spark: SparkSession, path: str, schema=None, declared: dict[str, str] | None = None, allow_errors: int = 0, **common) -> DataFrame:
    """PATH.nv2. name:value lines; a line that begins with # ends a record; lines without a colon and lines that are
    too deep are errors."""
    raw = _lines(spark, path, "\n#", **common).withColumns({n: f() for n, f in _PLACE.items()})

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out, kept = [], []
            for i, v in enumerate(b.column(0).to_pylist()):
                try:
                    rec = parse_nv2(v[1:] if v.startswith("#") else v)
                except ValueError:
                    if allow_errors <= 0:
                        raise
                    out.append(None)
                    kept.append(i)
                    continue
                if rec is not None:
                    out.append(json.dumps(rec))
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *[b.column(c).take(pa.array(kept, pa.int64())) for c in (1, 2, 3)]], names=["value", *_PLACE])

    parsed = raw.mapInArrow(run, "value string, __file string, __from bigint, __at bigint")
    return _from_json(with_errors_allowed(parsed, F.col("value").isNull(), allow_errors).select("value"), schema, declared)


def nv2_text(rec: dict, depth: int = 0) -> str:
    out = []
    for k, v in rec.items():
        for x in v if isinstance(v, list) else [v]:
            if x is None:
                continue
            tab = "\t" * depth
            out.append(f"{tab}{k}:\n{nv2_text(x, depth + 1)}" if isinstance(x, dict) else f"{tab}{k}:{str(x).lower() if isinstance(x, bool) else x}\n")
    return "".join(out)


@operator("write_nv2", "sink")
def write_nv2(df: DataFrame, path: str, **kw) -> None:
    """Writes PATH as nv2."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([nv2_text(r) + "#" for r in b.to_pylist()], pa.string())], names=["value"])

    _write(df.mapInArrow(run, "value string"), "text", path, **kw)


def _write(df: DataFrame, kind: str, path: str, gzip: bool = True, as_file: bool = False, overwrite: bool = False, options: dict | None = None, pri: tuple[str, Reductions] | None = None) -> None:
    """pri: an instance and the Reductions that get a row with the absolute path under that name."""
    df = df.coalesce(1) if as_file else df
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(kind).options(**(options or {}))
    (writer if kind == "parquet" else writer.option("compression", "gzip" if gzip else "none")).save(path)
    if pri:
        _, where = _hadoop(df.sparkSession, path)
        pri[1].put(pri[0], T.StructType([T.StructField("path", T.StringType())]), lambda: [where])


# --- the others -----------------------------------------------------------------------------------


@operator("json", "source")
def read_json(spark: SparkSession, path: str, lines: bool = False, schema=None, retype: bool = False, allow_errors: int = 0, allow_missing: bool = False, valid_regex: str | None = None) -> DataFrame:
    """PATH.json. An array of objects, {"name": [...]} around one, or JSON lines. retype: texts that look like
    numbers become numbers at every depth, and arrays in arrays become one. A text that isn't JSON is an error; without
    lines a file is one text, so that with allow_errors a bad file has no rows."""
    paths = _chosen(spark, path, allow_missing, valid_regex)
    if not paths:
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.option("multiLine", not lines)
    if lines and allow_errors > 0:
        found = schema if schema is not None else reader.option("mode", "DROPMALFORMED").json(paths).schema
        found = T.StructType.fromDDL(found) if isinstance(found, str) else found
        wide = T.StructType([*found.fields, T.StructField("__wrong", T.StringType())])
        df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__wrong").schema(wide).json(paths)
        wrong = F.col("__wrong").isNotNull()
        for c in found.names:  # whether a text is wrong depends on the columns read, so all are, wherever it is asked
            wrong = wrong | (F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) < 0)
        df = with_errors_allowed(df, wrong, allow_errors).select(*found.names)
    else:
        reader = reader.option("mode", "DROPMALFORMED" if allow_errors > 0 else "FAILFAST")
        df = (reader.schema(schema) if schema is not None else reader).json(paths)
    if not lines and len(df.columns) == 1 and V.is_multi(df, df.columns[0]) and V.is_record(df, df.columns[0]):
        df = df.select(F.explode(df.columns[0]).alias("r")).select("r.*")
    return retyped(df) if retype else df


def _rebuilt(c: Column, t: T.DataType, path: tuple[str, ...], leaf) -> Column:
    """A column with arrays in arrays flattened and its texts passed through leaf(column, path)."""
    while isinstance(t, T.ArrayType) and isinstance(t.elementType, T.ArrayType):
        c, t = F.flatten(F.array_compact(c)), t.elementType
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: _rebuilt(x, t.elementType, path, leaf))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_rebuilt(c[f.name], f.dataType, (*path, f.name), leaf).alias(f.name) for f in t.fields]))
    return leaf(c, path) if isinstance(t, T.StringType) else c


def _texts(c: Column, t: T.DataType, path: tuple[str, ...]) -> list[tuple[tuple[str, ...], Column]]:
    """All texts within a column, as an array for each path of names."""
    if isinstance(t, T.ArrayType):
        inner = _texts(F.lit(None), t.elementType, path)
        parts = {p: i for i, (p, _) in enumerate(inner)}
        gather = lambda i: F.flatten(F.transform(F.array_compact(c), lambda x: _texts(x, t.elementType, path)[i][1]))
        return [(p, F.coalesce(gather(i), F.array().cast("array<string>"))) for p, i in parts.items()]
    if isinstance(t, T.StructType):
        return [x for f in t.fields for x in _texts(c[f.name] if c is not None else c, f.dataType, (*path, f.name))]
    return [(path, F.array_compact(F.array(c.cast("string"))))] if isinstance(t, T.StringType) else []


def retyped(df: DataFrame) -> DataFrame:
    """Texts at every depth take the type that all values under their name have; arrays in arrays become one."""
    texts = [x for f in df.schema.fields for x in _texts(F.col(f.name), f.dataType, (f.name,))]
    kinds: dict[tuple[str, ...], str] = {}
    if texts:
        codes = [F.bit_or(F.aggregate(c, F.lit(0), lambda a, x: a.bitwiseOR(_code(x)))).alias(str(i)) for i, (_, c) in enumerate(texts)]
        seen = df.agg(*codes).first()
        kinds = {p: _KINDS[seen[i]] for i, (p, _) in enumerate(texts) if seen[i] in _KINDS}
    cast = lambda c, path: c.try_cast(kinds[path]) if path in kinds else c
    return df.select(*[_rebuilt(F.col(f.name), f.dataType, (f.name,), cast).alias(f.name) for f in df.schema.fields])


@operator("write_json", "sink")
def write_json(df: DataFrame, path: str, lines: bool = True, **kw) -> None:
    """Writes PATH as JSON: lines, or one array a file (a task's rows have to be few then)."""
    if lines:
        _write(df, "json", path, **kw)
        return
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    part = rows.groupBy(F.spark_partition_id()).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    _write(part.select("value"), "text", path, **kw)


@operator("tsv", "source")
def read_tsv(spark: SparkSession, path: str, fields: list[str] | None = None, delim: str = "\t", no_empty: bool = False, declared: dict[str, str] | None = None, allow_errors: int = 0, **common) -> DataFrame:
    """PATH.tsv. A header in each file (blanks become _), the first one's names for all, or `fields` and no header; no
    quoting; blank lines are skipped; rows of another width are errors."""
    paths = _chosen(spark, path, **common)
    if not paths:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in fields or []) or T.StructType([]))
    names = fields or [x.replace(" ", "_") for x in (spark.read.text(paths).filter("value <> ''").first() or [""])[0].split(delim)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "__wrong")])
    options = {"sep": delim, "header": str(fields is None).lower(), "quote": "", "nullValue": "\x01", "emptyValue": "", "columnNameOfCorruptRecord": "__wrong", "columnPruning": "false"}
    # Spark refuses to read the column of wrong rows alone, so the condition names another as well
    wrong = F.col("__wrong").isNotNull() | (F.length(F.coalesce(names[0], F.lit(""))) < 0)
    rows = with_errors_allowed(spark.read.options(**options).csv(paths, schema), wrong, allow_errors)
    out = rows.select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])  # a cell without characters is read as null
    if no_empty:
        out = out.withColumns({n: F.when(F.col(n) != "", F.col(n)) for n in names})
    return infer(out, declared)


@operator("write_tsv", "sink")
def write_tsv(df: DataFrame, path: str, delim: str = "\t", **kw) -> None:
    """Writes PATH as tsv: scalar columns in schema order, with a header; repeated fields are an error."""
    names = [c for c in df.columns if not V.is_record(df, c)]
    if many := [c for c in names if V.is_multi(df, c)]:
        raise ValueError(f"repeated fields can't be written as tsv: {many}")
    _write(df.select(names), "csv", path, options={"sep": delim, "header": "true", "quote": "", "emptyValue": ""}, **kw)


@operator("txt", "source")
def read_txt(spark: SparkSession, path: str, **common) -> DataFrame:
    """PATH.txt. A trimmed line a row in field txt; empty lines are rows too."""
    return _lines(spark, path, **common).select(F.trim("value").alias("txt"))


@operator("write_txt", "sink")
def write_txt(df: DataFrame, path: str, **kw) -> None:
    """Writes PATH as txt: all values, by blanks."""
    cols = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ") if V.is_multi(df, c) else F.col(c).cast("string") for c in df.columns]
    _write(df.select(F.concat_ws(" ", *cols).alias("value")), "text", path, **kw)


@operator("nat", "source")
def read_nat(spark: SparkSession, path: str) -> DataFrame:
    """PATH of the native format: Parquet."""
    return spark.read.parquet(path)


@operator("write_nat", "sink")
def write_nat(df: DataFrame, path: str, **kw) -> None:
    """Writes PATH as Parquet."""
    _write(df, "parquet", path, **{k: v for k, v in kw.items() if k != "gzip"})


#: Names of sub-record fields and of their fields in nvp files.
NVP_SUBS = ("clause", "keyword")
NVP_FIELDS = ("targetingClauseId", "subId", "bid", "expression", "type", "override", "clause")


def _nvp_parser(subs: tuple[str, ...], sub_fields: tuple[str, ...]):
    def parse(text: str) -> dict | None:
        rec: dict[str, list] = {}
        for line in text.split("\n"):
            name, found, v = line.strip().partition(":")
            if not found or not name:
                continue
            if name in subs:
                pairs = [p.partition(":") for p in v.split("|")]
                rec.setdefault(name, []).append({k: x for k, c, x in pairs if c and k in sub_fields})
            else:
                rec.setdefault(name, []).append(v)
        return {k: v if k in subs or len(v) > 1 else v[0] for k, v in rec.items()} or None

    return parse


@operator("djf", "source")
def read_djf(spark: SparkSession, path: str, keys: tuple[str, ...] = (), subs: tuple[str, ...] = NVP_SUBS, sub_fields: tuple[str, ...] = NVP_FIELDS, schema=None, declared: dict[str, str] | None = None, allow_errors: int = 0) -> DataFrame:
    """PATH.djf. Per record: with `keys`, a length and the key values by bars; a length and a deflated nvp record.

    Lengths are 32-bit big-endian. A file is read by one task. Another number of key values, what can't be inflated and
    a record cut short are errors.
    """
    parse = _nvp_parser(subs, sub_fields)

    def chunk(data: bytes, at: int) -> tuple[bytes, int]:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return data[at + 4 : end], end

    def records(data: bytes):
        at, left = 0, allow_errors
        while at < len(data):
            key = b""
            if keys:
                key, at = chunk(data, at)
            body, at = chunk(data, at)
            try:
                values = key.decode().split("|") if keys else []
                if at > len(data) or len(values) != len(keys):
                    raise ValueError(f"a record cut short, or key values {values} for {keys}")
                rec = parse(zlib.decompress(body).decode()) or {}
            except (ValueError, zlib.error):
                left -= 1
                if allow_errors <= 0:
                    raise
                if left == 0:
                    return
                continue
            yield {**rec, **dict(zip(keys, values, strict=True))}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for body in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in records(body)], pa.string())], names=["value"])

    return _from_json(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string"), schema, declared)


@operator("nvp", "source")
def read_nvp(spark: SparkSession, path: str, subs: tuple[str, ...] = NVP_SUBS, sub_fields: tuple[str, ...] = NVP_FIELDS, schema=None, declared: dict[str, str] | None = None, **common) -> DataFrame:
    """PATH.nvp. name:value lines, ---: ends a record; fields `subs` hold name:value pairs by bars."""

    parse = _nvp_parser(subs, sub_fields)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(r) for r in map(parse, b.column(0).to_pylist()) if r], pa.string())], names=["value"])

    return _from_json(_lines(spark, path, "---:", **common).mapInArrow(run, "value string"), schema, declared)


# --- by name or extension -------------------------------------------------------------------------


def _extension(path: str) -> str | None:
    """The format that the end of a path names, compression and a closing / apart."""
    end = re.sub(r"\.(gz|bz2)$", "", path.rstrip("/")).rpartition("/")[2].rpartition(".")
    return _EXTENSIONS.get(end[2].lower()) if end[1] else None


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether JSON files hold an object a line, by their first line."""
    first = (spark.read.text(path).filter(F.trim("value") != "").first() or [""])[0].strip()
    try:
        top = json.loads(first)
    except ValueError:
        return False
    wrapper = isinstance(top, dict) and len(top) == 1 and isinstance(next(iter(top.values())), list)
    return isinstance(top, dict) and not wrapper


@operator("read", "source")
def read(spark: SparkSession, path: str, format: str | None = None, **kw) -> DataFrame:
    """PATH[?format=F]. Files of the format named, or that the extension of the path or of its files names.

    A folder without an extension, written as text, needs `format`. JSON is taken as lines by its first line, unless
    `lines` says so. A path that may be missing, without a format, is an empty table."""
    kind = format or _extension(path) or next(filter(None, map(_extension, _files(spark, path))), None)
    if kind is None:
        if kw.get("allow_missing") and not _files(spark, path):
            return spark.createDataFrame([], T.StructType([]))
        raise ValueError(f"no format in {path}")
    if kind == "json" and "lines" not in kw and (_files(spark, path) or not kw.get("allow_missing")):
        kw["lines"] = _is_lines(spark, path)
    return _READERS[kind](spark, path, **kw)


@operator("write", "sink")
def write(df: DataFrame, path: str, format: str | None = None, report: str | None = None, **kw) -> None:
    """PATH.FORMAT. Writes in the format named, or that the extension of the path names. report: a text on the job,
    kept beside the rows with their number, fields and plan, for `origin`; the rows are counted as they are written."""
    kind = format or _extension(path)
    if kind not in _WRITERS:
        raise ValueError(f"no format to write in {path}")
    if report is None:
        _WRITERS[kind](df, path, **kw)
        return
    seen = Observation()
    _WRITERS[kind](df.observe(seen, F.count(F.lit(1)).alias("records")), path, **kw)
    write_report(df, path, report, seen.get["records"])


_READERS = {"nv2": read_nv2, "json": read_json, "tsv": read_tsv, "txt": read_txt, "nat": read_nat, "nvp": read_nvp, "djf": read_djf}
_WRITERS = {"nv2": write_nv2, "json": write_json, "tsv": write_tsv, "txt": write_txt, "nat": write_nat}
_EXTENSIONS = {**{k: k for k in _READERS}, "jsonl": "json", "ndjson": "json", "csv": "tsv", "parquet": "nat"}


# --- keyed stores, lineage and other sinks --------------------------------------------------------


@operator("mapDB", "sink")
def map_db(df: DataFrame, keys, table: str, buckets: int = 80, count: str | None = None, overwrite: bool = False, order_by: list | None = None) -> None:
    """mapDB:KEYS:TABLE. One row per key as a table bucketed and sorted by key: joins on it need no shuffle."""
    from weftline.operators.aggregate import uniq

    keys = V.fields(df, keys)
    _bucketed(uniq(df, keys, count, True, order_by), keys, table, buckets, overwrite)


@operator("groupDB", "sink")
def group_db(df: DataFrame, keys, table: str, child: str = "child", buckets: int = 80, count: str | None = None, overwrite: bool = False) -> None:
    """groupDB:KEYS:TABLE. Keys and their rows as sub-records, as a bucketed table."""
    from weftline.operators.keyed import group_by

    found = group_by(df, keys, child)
    out = found.df.withColumn(count, F.size(child).cast("bigint")) if count else found.df
    _bucketed(out, found.keys, table, buckets, overwrite)


def _bucketed(df: DataFrame, keys: list[str], table: str, buckets: int, overwrite: bool) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


@operator("natdb", "keyed")
def read_natdb(spark: SparkSession, table: str, keys: list[str]):
    """A keyed store as a keyed operand."""
    from weftline.operators.keyed import Keyed

    return Keyed(spark.table(table), keys)


@operator("print", "sink")
def print_rows(df: DataFrame, n: int = 20, with_types: bool = False) -> None:
    """print. The first rows as nv2 text."""
    if with_types:
        df.printSchema()
    for r in df.limit(n).collect():
        print(nv2_text(r.asDict(recursive=True)) + "#")


@operator("devnull", "sink")
def devnull(df: DataFrame) -> None:
    """devnull. Runs the pipeline and discards the rows."""
    df.write.format("noop").mode("overwrite").save()


@operator("write_report", "sink")
def write_report(df: DataFrame, path: str, expression: str = "", records: int | None = None) -> None:
    """Beside a written PATH, a record of the job: columns, plan, expression and number of rows (read by `origin`)."""
    spark = df.sparkSession
    row = [(path, expression, records, df.columns, [t for _, t in df.dtypes], df._jdf.queryExecution().simpleString())]
    spark.createDataFrame(row, "path string, expression string, records bigint, names array<string>, types array<string>, plan string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "_report"))


@operator("origin", "source")
def origin(spark: SparkSession, path: str, flatten: bool = False) -> DataFrame:
    """origin:PATH. The record of the job that wrote PATH; flatten: a row a field."""
    df = spark.read.json(os.path.join(path, "_report"))
    return df.select("path", F.explode(F.arrays_zip("names", "types")).alias("f")).select("path", F.col("f.names").alias("name"), F.col("f.types").alias("type")) if flatten else df


@operator("chartjs", "sink")
def chart(df: DataFrame, path: str, x: str = "x", y: str = "y", data_set: str | None = None, kind: str = "bar", title: str = "No Title", log: tuple[str, ...] = (), most: int = 5000) -> None:
    """chartjs:FILE. A page with a bar or point chart of a small result (more than `most` rows are an error)."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a chart takes at most {most} rows")
    sets: dict[str, list] = {}
    for r in rows:
        sets.setdefault(str(r.get(data_set)) if data_set else y, []).append({"x": r[x], "y": r[y]})
    body = {"type": "bar" if kind == "bar" else "scatter", "data": {"datasets": [{"label": k, "data": v} for k, v in sets.items()]}, "options": {"plugins": {"title": {"display": True, "text": title}}, "scales": {a: {"type": "logarithmic"} for a in log}}}
    with open(path, "w") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{title}</title><canvas id=c></canvas><script src=https://cdn.jsdelivr.net/npm/chart.js></script><script>new Chart(document.getElementById('c'),{json.dumps(body, default=str)})</script>")
