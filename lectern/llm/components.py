"""Connected components of links, by contracting: every node joins its least neighbour until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and root (the least node it is linked with by any path) of every node in links (a, b).

    A round is a few joins and minima of shrinking tables, each written before the next begins; there are about as
    many rounds as the logarithm of the longest chain.
    """
    edges = scratch.table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root"))
    roots, k = scratch.table(roots, f"{name}-roots-0"), 0
    while edges.head(1):
        k += 1
        up = scratch.table(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), f"{name}-up-{k}-0")
        j = 0
        while True:  # until all point to the top of their tree
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            j += 1
            up, before = scratch.table(up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up")), f"{name}-up-{k}-{j}"), up
            if not up.join(before.withColumnRenamed("up", "was"), "node").where("up <> was").head(1):
                break
        def top(df: DataFrame, c: str, up: DataFrame = up) -> DataFrame:
            return df.join(up.select(F.col("node").alias(c), "up"), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")

        roots = scratch.table(top(roots, "root"), f"{name}-roots-{k}")
        edges = top(top(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = scratch.table(edges, f"{name}-edges-{k}")
    return roots
