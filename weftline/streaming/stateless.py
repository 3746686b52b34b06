"""Streams: the stateless operators apply to them as they are; windows on event time are an addition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.pipeline import Pipeline


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def run_once(stream: DataFrame, pipeline: Pipeline, path: str, checkpoint: str) -> None:
    """All that is there now through a pipeline into Parquet files, resuming where the last call ended."""
    pipeline.run(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def windowed(df: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour", **aggs) -> DataFrame:
    """Aggregates by keys and tumbling windows; on a stream, rows later than `late` are left out."""
    df = df.withWatermark(time, late) if df.isStreaming else df
    out = df.groupBy(F.window(time, width).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggs)
