"""REPORT: what the jobs of a block of code did, as a DataFrame.

    with Report(spark) as seen:
        formats.devnull(df)
    pipeline.run(seen.rows())

The figures are Spark's own, as its SQL page shows them; they are there without that page as well. There is a row a
metric of a plan's node, so the rows grow with the plans, not with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "execution bigint, description string, node bigint, operator string, metric string, value string, rows bigint"


class Report:
    """The executions begun within the block. rows: the count of a node's output rows, on that metric."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._store = spark._jsparkSession.sharedState().statusStore()
        self._found: list[tuple] = []

    def _executions(self) -> list:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = self._store.executionsList()
        return [found.apply(i) for i in range(found.size())]

    def __enter__(self) -> Report:
        self._before = max((e.executionId() for e in self._executions()), default=-1)
        return self

    def __exit__(self, *_: object) -> None:
        for e in self._executions():
            if (at := e.executionId()) <= self._before:
                continue
            values, nodes = self._store.executionMetrics(at), self._store.planGraph(at).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    value = values.get(m.accumulatorId())
                    if value.isDefined():
                        text = value.get()
                        count = int(text.replace(",", "")) if m.name() == "number of output rows" and text.replace(",", "").isdigit() else None
                        self._found.append((at, e.description(), node.id(), node.name(), m.name(), text, count))

    def rows(self) -> DataFrame:
        """A row a metric: execution, description, node, operator, metric, value as text."""
        return self.spark.createDataFrame(self._found, SCHEMA)
