"""Connected components of a table of links, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import settle


def _hanging(edges: DataFrame) -> DataFrame:
    """Nodes that hang on two others, or hang on one while others hang on them; none once every component is a star."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 OR (n = 1 AND least = 0)")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of a link (columns a, b); component is the smallest id that links lead to.

    In turn each node's larger neighbours, then its smaller ones, are hung on the smallest id near it, until each
    component is a star. A node's neighbours are never gathered: minima are aggregated and joined back.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _hanging(edges).isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(hung.select("e.u", "e.v").where("u <> v").distinct())
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
