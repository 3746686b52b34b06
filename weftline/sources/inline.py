"""Sources without files: inline rows, blank rows, nothing, rows handed over by code."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from weftline.registry import operator


@operator("inline", "source")
def inline(spark: SparkSession, rows: list, schema) -> DataFrame:
    """[ REC REC ... ]. Literal rows."""
    return spark.createDataFrame(rows, schema)


@operator("blanks", "source")
def blanks(spark: SparkSession, n: int) -> DataFrame:
    """blanks:N. N rows without fields; -1: an endless stream of them."""
    if n < 0:
        return spark.readStream.format("rate").load().select()
    return spark.range(n).select()


@operator("empty", "source")
def empty(spark: SparkSession, schema) -> DataFrame:
    """empty. No rows; keyed, a source without hits."""
    return spark.createDataFrame([], schema)


@operator("stdin", "source")
def stdin(spark: SparkSession) -> DataFrame:
    """stdin://. The lines of the driver's standard input, in field txt; for small inputs."""
    return spark.createDataFrame([(x.strip(),) for x in sys.stdin], "txt string")
