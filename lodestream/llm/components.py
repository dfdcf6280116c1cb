"""Connected components of a link table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import materialize


def _oriented(a, b, links: DataFrame) -> DataFrame:
    return links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _oriented(F.col("v"), F.col("m"), both.join(least, "u").filter("v > u"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    return _oriented(F.col("a"), F.col("m"), joined.select(F.col("v").alias("a"), "m").unionByName(joined.select(F.col("u").alias("a"), "m")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b) of longs: root is the least node reachable; nodes without links are left out.

    Alternates large and small stars, which takes rounds as the logarithm of the nodes at most squared, and never gathers
    a node's neighbours: they are aggregated and joined, so that a node with many can be split.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = materialize(_oriented(F.col("a"), F.col("b"), links))
    seen = mark(stars)
    while seen[0]:
        stars = materialize(_small_star(_large_star(stars)))
        now = mark(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
