"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.session import cut_lineage


def _forest(batches):
    """Spanning forest of each batch of edges: (u, v) with v the least node of its tree."""
    for batch in batches:
        ends = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if not ends.size:
            continue
        nodes, at = np.unique(ends, return_inverse=True)
        parent = list(range(len(nodes)))
        for a, b in at.reshape(2, -1).T.tolist():
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
        for i in range(len(parent)):  # parents are smaller: one pass upward ends at the roots
            parent[i] = parent[parent[i]]
        parent = np.array(parent)
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[child]), pa.array(nodes[parent[child]])], names=["u", "v"]
        )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of ``edges`` (u, v of one type) with the least node it reaches.

    Every batch of edges is first cut to a spanning forest in place.  Then each round points
    every node at its least smaller neighbour, follows the pointers to their end by
    doubling, and contracts the edges, so rounds grow with the logarithm of the longest
    path, not with the size of a component.  Neighbours are reduced with a
    pre-aggregated minimum: the centre of a giant star is one row.  Tables are written
    each round; no component meets in one task.  Without edges the result is empty.
    """
    of = edges.schema["u"].dataType.simpleString()
    kind = f"u {of}, v {of}"
    now = cut_lineage(edges.select("u", "v").filter("u <> v").mapInArrow(_forest, kind))
    levels: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hop = cut_lineage(
            both.groupBy("u").agg(F.min("v").alias("p")).filter("p < u").select("u", "p")
        )
        while True:
            above = hop.select(F.col("u").alias("p"), F.col("p").alias("q"))
            higher = hop.join(above, "p", "left")
            if higher.filter("q is not null").isEmpty():
                break
            hop = cut_lineage(higher.select("u", F.coalesce("q", "p").alias("p")))
        levels.append(hop)
        u, v = (hop.select(F.col("u").alias(c), F.col("p").alias(f"p{c}")) for c in "uv")
        moved = now.join(u, "u", "left").join(v, "v", "left")
        moved = moved.select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        now = cut_lineage(moved.filter("u <> v").distinct().mapInArrow(_forest, kind))
    if not levels:
        return edges.sparkSession.createDataFrame([], f"node {of}, component {of}")
    found = levels[-1]
    for hop in reversed(levels[:-1]):
        top = found.select(F.col("u").alias("p"), F.col("p").alias("q"))
        lower = hop.join(top, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        found = found.unionByName(lower)
    found = found.select(F.col("u").alias("node"), F.col("p").alias("component"))
    roots = found.select("component").distinct()
    return found.unionByName(roots.select(F.col("component").alias("node"), "component"))
