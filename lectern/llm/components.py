"""Connected components by alternating large and small stars.

Edges are contracted to forests within each partition before every shuffle, then stars alternate until
the edges are stars, a number of rounds that grows with the logarithm of the number of nodes. There is
one path at every size. Every round's edges are written to the checkpoint folder. Nothing is collected
but a flag a round and the hubs: nodes with more than one in ``SHARE`` of all edges, fewer than twice
``SHARE`` however large the graph; what they point to is mapped without moving their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SHARE, checkpointed

#: Nodes that a task's forest holds before it is handed on and started anew.
FOREST_NODES = 400_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def out(schema):
        rows = [(x, find(x)) for x in list(parent)]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        return None

    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > FOREST_NODES and (got := out(schema)) is not None:
            yield got
    if schema is not None and (got := out(schema)) is not None:
        yield got


def contracted(edges: DataFrame) -> DataFrame:
    """A forest of each partition's edges, as (node, least node of its tree); no shuffle."""
    return edges.mapInArrow(forest, edges.schema)


def _raised(edges: DataFrame, least: DataFrame, hubs: dict) -> DataFrame:
    """Edges (u, v) as (u, the least node that v knows); edges of hubs stay where they are."""
    if not hubs:
        return edges.join(least.select(F.col("x").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
    hub, kind = F.col("v").isin(list(hubs)), edges.schema["v"].dataType
    cold = edges.filter(~hub).join(least.select(F.col("x").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
    places = F.create_map(*(F.lit(x).cast(kind) for pair in hubs.items() for x in pair))
    return cold.unionByName(edges.filter(hub).select("u", places[F.col("v")].alias("v")))


def _star(edges: DataFrame) -> DataFrame:
    """One large and one small star of edges (u, v) with u > v."""
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = checkpointed(ends.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n"))
    many = 2 * max(edges.count(), SHARE)
    hubs = {r.x: r.m for r in least.filter(F.col("n") * SHARE > many).select("x", "m").collect()}
    large = checkpointed(contracted(_raised(edges, least, hubs).filter("u > v")))
    # A node has at most one edge up in each partition now: its lower neighbours and itself go to the least of them.
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).filter("n > 1").select("u", "m")
    up = large.join(low, "u", "left").withColumn("m", F.coalesce("m", "v"))
    stays = F.col("v") == F.col("m")
    return up.select(F.when(stays, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _is_star(edges: DataFrame) -> bool:
    """No node has two edges up, none is both a leaf and a root."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not seen.filter("up > 1 or (up = 1 and down = 1)").limit(1).count()


def components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)`` that isn't its component's least node.

    ``u`` and ``v`` have one orderable type without nulls; order, direction, repeats and loops don't matter.
    ``forests``: the step that made the edges has put them through ``forest``, so no second worker does.
    """
    edges = edges.select("u", "v").filter("u <> v")
    edges = checkpointed((edges if forests else contracted(edges)).distinct())
    while not _is_star(edges):
        edges = checkpointed(_star(edges))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
