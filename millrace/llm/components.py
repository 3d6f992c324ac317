"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Tables


def stars(down: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if one leads to it."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = down.select(F.inline(ends)).groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not nodes.where("out > 1 or (out = 1 and in = 1)").head(1)


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b), root the least node
    of its component.

    Large star: every node hands its least neighbour to its larger neighbours.
    Small star: to its smaller ones and itself. Both shrink distances until
    every edge leads to a root, which ends it; hot nodes are only ever aggregated by a minimum
    or joined, never gathered.
    """
    tables = tables or Tables(edges.sparkSession)
    down = tables.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not stars(down):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Those below a minimum of their own keep their edge to it.
        large = tables.keep(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = tables.keep(small.where("u <> v").distinct())
        del both, least, small
        tables.drop(down, large)
        down = after
    roots = down.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return tables.keep(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
