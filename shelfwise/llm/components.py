"""Connected components of a graph whose edges are a DataFrame, by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest of its neighbours, small-star every smaller one and
itself. Both keep the components; repeated they turn each into a star around its smallest node, in about as many rounds as the
logarithm of the longest path. Minima are combined before the shuffle, and joins on a hub are left to the planner's skew splitting. Edges
are contracted inside their tasks first, so that what one task has connected costs no rounds. Every round is written to the shared folder, so
lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import materialized

# Nodes that a task connects at a time.
HELD_NODES = 200_000


def contract(batches: Iterator[pa.RecordBatch], held_nodes: int = HELD_NODES) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars of what the edges of a task connect, a bounded number of nodes at a time."""
    parent: dict = {}

    def root(node):
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[above]
        return node

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        rows = [(node, top) for node in parent if (top := root(node)) != node]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > held_nodes:
            yield stars(batch.schema)
            parent.clear()
    if parent:
        yield stars(batch.schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half round over distinct edges (u > v)."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Larger neighbours of u are those that u is the smaller end of.
        joined = edges.join(least.withColumnRenamed("u", "w"), F.col("v") == F.col("w"))
        return joined.select("u", F.col("m").alias("v")).where("u <> v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, contracted: bool = False) -> DataFrame:
    """``edges`` (a, b) to (node, root), root the smallest node of the component; nodes without an edge to another are left out.

    ``contracted``: the Python step that finds the edges ends in ``contract``. As a step of its own it would take a second Python
    worker for every core, and workers stay.
    """
    if not contracted:
        edges = edges.select("a", "b").where("a <> b")
        edges = edges.mapInArrow(lambda batches: contract(batches, HELD_NODES), edges.schema)
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialized(edges, "edges")
    while not _are_stars(edges):
        edges = materialized(_star(_star(edges, large=True), large=False), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is the smaller end of none."""
    larger = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    smaller = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = larger.union(smaller).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).agg(F.count("*")).head()[0] == 0
