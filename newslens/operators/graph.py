"""Connected components: forests of each part, then alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of one part of a round's tables, of which a task holds the forest at a time.
EDGES_OF_PART = 200_000


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of the edges with the least node that the task has found connected to it."""
    root: dict = {}
    held = 0

    def find(x):
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pd.DataFrame:
        pairs = [(x, find(x)) for x in list(root)]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"])

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            x, y = find(u), find(v)
            low, high = (x, y) if x < y else (y, x)
            root[low] = low
            root[high] = low
        held += len(batch)
        if held >= EDGES_OF_PART:
            yield stars()
            root.clear()
            held = 0
    if root:
        yield stars()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from the greater node to the less
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up, or edges from others only."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0), F.lit(1)))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``edges`` (u, v of one ordered type) → (node, root): root is the least node of the component.

    Every node that has an edge to another node gets a row; loops and null ends are ignored. ``keep``
    writes a table to storage that all executors share and reads it back, which cuts the lineage of each
    round. Each task first reduces its edges to stars; what is left is cut into as many parts as its number
    of edges asks for and reduced again. With one part that is all; else rounds join what several parts have
    of a component, until the edges are stars around the roots.
    """
    clean = edges.select("u", "v").where("u != v")
    forests = lambda df: df.mapInPandas(_forests, clean.schema)
    e = keep(forests(clean))
    parts = -(-e.count() // EDGES_OF_PART)
    if parts:
        e = keep(forests(e.coalesce(parts)))
    while parts > 1 and not _are_stars(e):
        e = keep(_large_star(e).coalesce(parts))
        e = keep(forests(_small_star(e).coalesce(parts)))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
