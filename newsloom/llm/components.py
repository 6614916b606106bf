"""Connected components, by union-find in partitions and by rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as A
from .lineage import cut


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's edges as stars: each node with the least node it is linked with inside the batch."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, inv = np.unique(np.r_[a, b], return_inverse=True)
        parent = np.arange(len(nodes))
        x, y = inv[: len(a)], inv[len(a) :]
        while True:  # union by hooking to the lesser root, find by pointer jumping, all edges at once
            px, py = parent[x], parent[y]
            low = np.minimum(px, py)
            old = parent.copy()
            np.minimum.at(parent, px, low)
            np.minimum.at(parent, py, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            if (parent == old).all():
                break
        moved = parent != np.arange(len(nodes))
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[parent[moved]])], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b); a component is named by its least node.

    Edges are first contracted by union-find within each batch. Then rounds of large-star and
    small-star steps, each an aggregation per node, until nothing changes; no component is ever
    gathered in one place. Loops are fine; nodes without an edge have no row.
    """
    e = A.over(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), _union_find, "a long, b long")
    e = cut(e.distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(m, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small, "edges")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
