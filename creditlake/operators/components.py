"""Connected components of an undirected graph given as an edge DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many edges are joined up by one union-find task (a few hundred MB); more are joined up by star rounds.
ONE_TASK_EDGES = 200_000


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (hi, lo) edges, hi > lo; both keep every component whole."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select("lo", "hi"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(low, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionAll(low.select("hi", F.col("m").alias("lo"))).distinct()


def _union_find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for f in frames:
        for a, b in zip(f["hi"], f["lo"], strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"hi": nodes, "lo": [root(x) for x in nodes]})


def connected_components(edges: DataFrame, save: Callable[[DataFrame], DataFrame], one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every node that is not the smallest of its component.

    edges: two columns of one ordered type, the ends of each edge; nulls and self loops count as nothing, repeats as one.
    save: writes a frame to storage that all executors share and reads it again, so that a lost executor costs no lineage.
    The smallest node of a component is its label and has no row. No edge gives an empty frame.
    """
    a, b = edges.columns[:2]
    e = save(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND hi > lo").distinct())
    n = e.count()
    if n <= one_task_edges:
        e = e.coalesce(1).mapInPandas(_union_find, e.schema)
    else:
        state = None
        while True:
            e = save(_stars(e))
            now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
            if now == state:
                break
            state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
