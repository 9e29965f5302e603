"""Connected components of a graph that lies in a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import durable

FEW = 1 << 20  # links that one task joins: some 100 MB of arrays


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, names = _joined(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(names)], names=["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, few: int = FEW) -> DataFrame:
    """(node, component) of every node that a link names; a component is named by its smallest node.

    Up to `few` distinct links, which are counted first, one task joins them. Beyond, rounds of
    joins do: each round moves a node's larger neighbours to its smallest one, then a node's smallest
    neighbour's others to that one, until every node points at its root. A node with many
    neighbours is rows of its own in every join, never a list. The driver sees one row a round.
    Null ends are ignored, loops and repeated links make no difference.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = durable(ends.filter("u = v").select("u").distinct())
    edges = durable(ends.filter("u <> v").distinct())
    if edges.schema["u"].dataType.simpleString() == "bigint" and edges.count() <= few:
        # A loop is a link like any other here, and gives its node a name.
        every = edges.unionByName(loops.select("u", F.col("u").alias("v")))
        return durable(every.coalesce(1).mapInArrow(_in_one_task, "node long, component long"))
    before = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = up.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        edges = durable(up.join(root, "u").select(F.explode(moved).alias("e")).select("e.*").filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    lone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found, "node", "left_anti")
    return durable(found.unionByName(lone))
