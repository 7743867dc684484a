"""Connected components of a distributed edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over rows (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    linked = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether all components are stars: no node has two edges upwards, or one upwards and one downwards."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(F.col("up") + F.col("down") * F.signum("up") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge with the smallest node of its component. edges: (u, v) of any one
    ordered type. Rounds grow with the logarithm of the longest path; each is written to the shared folder."""
    now = stored(_stars(_tidy(edges)), "edges")
    while not _done(now):
        last, now = now, stored(_stars(now), "edges")
        release(now.sparkSession, last)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out = stored(nodes, "components")
    release(now.sparkSession, now)
    return out
