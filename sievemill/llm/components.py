"""Connected components of an edge table, by alternating stars over joins and pre-aggregated minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm.common import checkpoint, map_arrow

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' component, from index pairs."""
    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label != (nxt := label[label])).any():
            label = nxt


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges becomes stars around its components' smallest nodes: as connected, and no more edges."""
    for batch in batches:
        u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots_of(len(nodes), where[: len(u)], where[len(u) :])
        rest = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[root[rest]])], schema=_EDGES)


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node that an edge links to another.

    Null ends and loops are dropped, repeated edges count once, no edges give no rows. The minima are aggregated before
    they are shuffled, and the joins read plain exchanges, whose hot keys adaptive execution splits.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    edges = checkpoint(spark, map_arrow(edges, _local_stars, "u long, v long").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        edges = checkpoint(spark, _small_star(_large_star(edges)))


def _with_minimum(edges: DataFrame) -> DataFrame:
    """u, v, low: the smallest neighbour of u. The xor hides the aggregate's partitioning, so that the join shuffles
    both sides and can split a hub."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).select(F.expr("u ^ 0L").alias("u"), "low")
    return edges.join(low, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_minimum(both).filter("v > u")
    return found.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest neighbour."""
    found = _with_minimum(edges)
    pairs = F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))
    return found.select(F.explode(pairs).alias("p")).select("p.u", "p.v").filter("u <> v").distinct()
