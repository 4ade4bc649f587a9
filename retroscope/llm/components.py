"""Connected components in Spark: stars are enlarged and shrunk in turns until nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """v, root for every node of ``links`` (a, b): root is the smallest node that links lead to.

    Each round hooks neighbours onto the smallest one they see, until all are stars; the number of rounds grows with
    the logarithm of the component size. A hub's rows are joined to its smallest neighbour, which
    Spark may split; only smaller neighbours, few once hubs are hooked, are seen together. Loops and
    repeated links are allowed; no links give no rows.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while not _stars(edges):
        # larger neighbours of a node move to its smallest, or to itself
        both = edges.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("e")).select("e.*")
        low = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u"))
        # smaller neighbours of a node, and the node itself, move to the smallest of them
        small = large.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        moved = small.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        edges = cut_lineage(moved.select("e.*").where("v <> u").distinct())
    roots = edges.select(F.col("u").alias("v")).distinct().select("v", F.col("v").alias("root"))
    return edges.select("v", F.col("u").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every node either has edges from larger nodes or a single one to a smaller node: then nothing moves any more."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("v").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                         F.struct(F.col("u").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
