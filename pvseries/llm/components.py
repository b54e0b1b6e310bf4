"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvseries.sources.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is one node of its component.

    Each round sends a node to its smallest neighbour, follows two more steps of that way, and
    contracts the links to the nodes that were reached, so the graph shrinks every time. All
    tables are saved between rounds. A node of any degree takes part through pre-aggregated
    minima and joins that adaptive execution may split.
    """
    left = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("u")).union(
            left.select(F.col("b").alias("v"), F.col("a").alias("u")))
        way = materialise(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), "way")
        for _ in range(2):
            way = way.join(way.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p"))
        way = materialise(way, "way")
        steps.append(way)
        left = materialise(
            left.join(way.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
            .join(way.select(F.col("v").alias("b"), F.col("p").alias("y")), "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for way in steps[1:]:
        out = out.join(way.select(F.col("v").alias("root"), "p"), "root", "left").select(
            "node", F.coalesce("p", "root").alias("root"))
    return out
