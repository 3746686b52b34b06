"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the ASCII-white-space convention, as a pattern that Java and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are taken in slices of about so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1_000_000
#: Spark hands batches of at most about so many bytes to a Python worker; by itself it counts rows only.
BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
HELD_OUT_REMAINDER, FOLDS = 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read back, its lineage cut.

    The folder is the session's spark.checkpoint.dir; only where it is unset (local runs) a
    temporary one is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    out = df.checkpoint()
    # shuffle files go when the driver collects its garbage, which it may not do for long: see to it here
    gc.collect()
    give_back()
    sc._jvm.System.gc()
    trim(spark)
    return out


def trim(spark: SparkSession) -> bool:
    """What the driver's JVM has freed outside its heap (of compressors and messages: with hundreds of tasks a stage
    hundreds of MB that the C library keeps) goes back to the system. False on a JVM without such a command."""
    jvm = spark.sparkContext._jvm

    def array(kind, *values):
        out = spark.sparkContext._gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    try:
        # the server's own class is not open to reflection; its interface is
        name, of = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), jvm.java.lang.Class.forName
        invoke = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.Class, name.getClass(), *map(of, ("java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.Object, name, "systemTrimNativeHeap", array(jvm.Object), array(jvm.String)))
    except Py4JError:
        return False
    return True


def held_out(id_col: str):
    """True where crc32 of the id as text leaves remainder 2 of 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT_REMAINDER, F.lit(False))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size_col: str | None = "text") -> DataFrame:
    """`fn` over slices of bounded bytes of Arrow batches; rows keep their order.

    Sets the session's bound on the bytes of an Arrow batch.
    """
    df.sparkSession.conf.set(_BATCH_CONF, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size_col):
                out = fn(part)
                if out is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory goes back to the system: a worker serves many tasks, and the next one may run beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freeing(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`fn` of one group, and what it used given back if the group was large."""

    def run(table: pa.Table) -> pa.Table:
        large = table.nbytes > SLICE_BYTES
        out = fn(table)
        del table
        if large:
            give_back()
        return out

    return run


def slices(batch: pa.RecordBatch, size_col: str | None) -> Iterator[pa.RecordBatch]:
    if size_col is None or batch.num_rows == 0:
        yield batch
        return
    column = batch.column(batch.schema.get_field_index(size_col))
    ends = np.cumsum(lengths(column))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1, from 0) of a string, binary or list<number> column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each row of a string, binary or list<int> column."""
    if pa.types.is_list(column.type):
        return 4 * np.diff(column.offsets.to_numpy())
    return np.diff(raw(column)[1])


def texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def batch_of(schema_like: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A RecordBatch from {name: (values, type)}."""
    names = list(schema_like)
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in schema_like.values()], names=names)


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from the bytes of `values` cut at `offsets` (in items)."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((np.asarray(offsets) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def list_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets).astype(np.int32)), pa.array(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps on purpose."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: str, text_col: str = "text") -> DataFrame:
    """`df` with the columns that `fn` makes of slices of it; `new` is their schema. Columns of these names are replaced."""
    made = [f.strip().split(" ")[0].strip("`") for f in new.split(",")]
    keep = [c for c in df.columns if c not in made]
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), new])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out = fn(part)
        return pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], *[out[c] for c in made]], names=[*keep, *made])

    return map_rows(df, run, schema, text_col)
