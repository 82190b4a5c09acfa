"""Connected components of an edge table that no task and no driver ever holds as a whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import ROWS, batches, cut


def _local_forest(it):
    """Union-find over one partition's edges: each node with the least node it reaches there, as a star."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches(it):
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, most_rounds: int = 64, *, rows: int = ROWS) -> DataFrame:
    """(id, component) for each end of an edge (u, v): component is the least id that it reaches.

    A union-find runs over each partition of ``rows`` edges first and leaves stars; if that was all of them, it is
    done. Else each round hangs every neighbour of a node onto the least of them (the larger ones, then the smaller
    ones), so paths halve. Edges are checkpointed between rounds. The rounds end when none moves an edge; edges
    that have not settled after ``most_rounds`` raise RuntimeError, since a part of the result is none.
    """
    given = cut(edges.where("u <> v").select("u", "v"), rows)
    stars = cut(given.mapInArrow(_local_forest, "u long, v long"), rows)
    for _ in range(most_rounds if given.rdd.getNumPartitions() > 1 else 0):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("moved"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))
        new = cut(small.where("u <> v").groupBy("u", "v").agg(F.max("moved").alias("moved")), rows)
        stars = new.select("u", "v")
        if new.where("moved").isEmpty():
            break
    else:
        if given.rdd.getNumPartitions() > 1:
            raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    nodes = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return cut(nodes.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), rows)
