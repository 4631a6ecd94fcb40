"""Union-find grouping of links that are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut


def _local_forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's links; what is left is one link from each node to its local root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def forest() -> pd.DataFrame:
        rows = [(x, root(x)) for x in parent]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"], dtype="int64")

    for pdf in parts:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # bounded memory: hand over the forest and start anew
            yield forest()
            parent.clear()
    yield forest()


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has one itself."""
    parents = edges.groupBy("u").agg(F.count("*").alias("c"))
    if parents.filter("c > 1").limit(1).count():
        return False
    return not edges.join(parents.select(F.col("u").alias("p")), F.col("v") == F.col("p"), "left_semi").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs -> (id, component): the smallest id reachable. Only linked ids have a row.

    Each partition first reduces its links by union-find. The partial forests are then joined by alternating
    large-star and small-star rounds, which move every node to the smallest neighbour without holding the
    neighbours of a node together, so that one huge group is only a skewed join. Null ids are dropped; no links: no
    rows. The result is a written table; the tables of the rounds are deleted.
    """
    with Scratch(links.sparkSession) as steps:
        edges = steps.cut(links.select("u", "v").dropna().filter("u <> v").mapInPandas(_local_forest, "u long, v long"), "links")
        while not _is_star_forest(edges):
            both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = steps.cut(large.filter("u <> v"), "large")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            edges = steps.cut(small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct(), "small")
        roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
        return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
