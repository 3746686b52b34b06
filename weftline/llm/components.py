"""Connected components of an edge table: by alternating star contraction, as joins and aggregates, or of a few edges in the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

#: Up to so many different edges (of at most some 40 bytes) are sent to the driver.
GATHERED = 500_000


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); the component is its smallest node.

    Each round points every node's larger neighbours at its smallest one, then every node and its
    smaller neighbours at the smallest of these, until nothing changes. Only per-node minima are
    gathered (with partial aggregation); neighbour lists are never collected, and the joins back
    can be split where a node is hot. Every round ends in a reliable checkpoint. At most `GATHERED` edges
    are joined in the driver instead, with the same result: a round of jobs would cost more than its edges.
    """
    state = common.cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if state.count() <= GATHERED:
        return joined(state)
    last = None
    for _ in range(max_rounds):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        state = common.cut(small.filter("u <> v").distinct())
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())


def joined(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of a few edges (u, v)."""
    found = edges.select("u", "v").toArrow()
    kind = found.schema.field("u").type
    ends = pa.chunked_array([*found.column("u").chunks, *found.column("v").chunks], kind).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    nodes, rank = ends.dictionary.take(order), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    u, v = rank[ends.indices.to_numpy()].reshape(2, -1)
    del found, ends
    low = lowest(u, v, len(nodes))
    schema = f"node {edges.schema['u'].dataType.simpleString()}, component {edges.schema['u'].dataType.simpleString()}"
    return common.cut(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "component": nodes.take(pa.array(low))}), schema))


def lowest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges. In each round the nodes that stand for trees
    are hung onto their smallest neighbour, so one with a neighbour is gone after two."""
    low = np.arange(n)
    while True:
        u, v = low[u], low[v]
        apart = u != v
        if not apart.any():
            return low
        u, v = u[apart], v[apart]
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]
