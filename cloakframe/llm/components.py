"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of it and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it is connected with) for each node of the edges (a, b).

    A round halves the paths at least, so their number is logarithmic.  Hot nodes: minima are aggregated before the
    shuffle, and the joins can be split by Spark.  Only counts reach the driver.
    """
    edges = materialise(edges.where("a <> b").distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = materialise(_small_star(_large_star(edges)).where("a <> b").distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
