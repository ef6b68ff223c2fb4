"""Connected components over edge tables, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import discard, written


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge upwards, or only edges from below."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)).distinct())
    sums = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the smallest node of its component.

    Alternating stars: every node links its larger neighbours, then its smaller
    ones, to the smallest node around it, until each component is one star.  A
    round never adds edges, and makes a row for each at most.  Rounds are written to
    the shared folder; only whether they are stars yet reaches the driver.
    """
    tall = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).alias("e")
    now = written(edges.where("a <> b").select(tall).select("e.*").distinct(), "edges", tidy=False)
    while not _stars(now):
        around = now.select("a", F.col("b").alias("x")).union(now.select(F.col("b").alias("a"), F.col("a").alias("x")))
        least = written(around.groupBy("a").agg(F.min("x").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least", tidy=False)
        large = written(now.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct(), "edges", tidy=False)
        below = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least", tidy=False)
        small = large.join(below, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = written(small.distinct(), "edges", tidy=False)
        discard(now, least, large, below)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())
