"""Connected components of an edge table by alternating stars, with map-side minima and no collected groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


#: Nodes that a task holds while it shortens the chains of its own edges.
HELD = 500_000


def _shortened(batches):
    """Edges of the same components: those of a task become stars, so that chains need few rounds."""
    parent: dict = {}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars(kinds) -> pa.RecordBatch:
        edges = [(x, r) for x in parent if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], kinds[i]) for i in (0, 1)], ["u", "v"])

    kinds = None
    for batch in batches:
        kinds = [c.type for c in batch.columns]
        for u, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > HELD:
            yield stars(kinds)
    if parent:
        yield stars(kinds)


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node reachable. Types need an order only.

    Large star: neighbours above u point to the least of u and its neighbours. Small star: u and its smaller neighbours
    point to the least of them. The number of edges never grows, and the rounds grow with the logarithm of the nodes.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    kind = edges.schema["u"].dataType.simpleString()
    stars = edges.filter("u <> v").select("u", "v").mapInArrow(_shortened, f"u {kind}, v {kind}")
    now = scratch.save(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minima(both).withColumn("m", F.least("m", "u")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        found = large.join(_minima(large), "u")
        small = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small)
        scratch.drop(now)
        now = after
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == was or not state[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
