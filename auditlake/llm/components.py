"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, written


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star round over edges (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "cc-least", 2 * n)
    large = join_keyed(both, least, "a", "n", 2 * n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    large = written(large, "cc-large", n)
    low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "cc-low", n)
    joined = join_keyed(large, low, "a", "n", large.count())
    small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return written(small.filter("a <> b").distinct(), "cc-small", 2 * n)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that is not a root itself; root is the component's smallest node."""
    n = edges.count()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges", n)
    while True:
        # done when every node has one edge, to a root
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        n, left = each.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 OR (up = 1 AND down > 0)"))).first()
        if not left:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = _stars(now, n)
