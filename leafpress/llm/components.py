"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of the links, ``node`` and ``root``, the smallest node that it reaches.

    Every round moves links to smaller neighbours: first each node's larger
    neighbours go to the smallest of all its neighbours, then its smaller ones do.
    Stars are left in the end, after rounds in the order of the logarithm of the
    number of nodes.  A round is two joins of the links with one row for each node, which Spark
    splits where a node has very many links, and is written to the checkpoint
    folder; the driver sees two numbers.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct().checkpoint(eager=True)
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = small.distinct().checkpoint(eager=True)
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
