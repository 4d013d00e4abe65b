"""Connected components of an edge table, as joins and aggregations that never gather the graph in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogforge.session import cut


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one Arrow batch at a time: a star per local component replaces its edges."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(batch.a.tolist(), batch.b.tolist()):
            if (ra := root(a)) != (rb := root(b)):
                parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"a": np.array(nodes, dtype="int64"), "b": np.array([root(x) for x in nodes], dtype="int64")})


def _hook(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: every neighbour of a node (the larger or the smaller ones) is hung on the node's least neighbour."""
    if small:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hung = seen.join(least, "u")
    if small:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        out = hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; the component is its least node.

    Edges are first contracted by union-find within Arrow batches, then large-star and small-star steps run until nothing
    changes (a logarithmic number of rounds); every round is written to the shared folder. A graph that still changes in
    the last of ``limit`` rounds is an error. Edges with a null end and loops are dropped; an empty table gives an empty table.
    """
    clean = edges.filter("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    stars = cut(clean.mapInPandas(_contract, "a bigint, b bigint"), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
    before = None
    for _ in range(limit):
        stars = cut(_hook(_hook(stars, small=False), small=True), "stars")
        now = mark(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {limit} rounds")
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.union(stars.select("b", "b")).distinct()
