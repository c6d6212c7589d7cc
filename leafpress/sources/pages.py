"""Pages that were fetched before: spreading them out and resolving URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators.skew import skew_join


def spread(pages: DataFrame, workers: int | None = None, key: str = "page_id") -> DataFrame:
    """Deal rows over ``workers`` tasks (default: all cores) by hash of the key.

    For inputs of few splits; one that has many needs no spreading.
    """
    workers = workers or pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(workers, F.col(key))


def one_per_url(pages: DataFrame, url: str = "url", latest: str = "page_id") -> DataFrame:
    """One row for each URL: of repeated fetches that with the largest ``latest``.

    The choice is made on the two narrow columns, and only URLs that stand more
    than once are looked at again; other rows are not moved.  Of rows that agree in
    both columns one stays.
    """
    repeated = pages.groupBy(url).agg(F.max(latest).alias("_latest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    single = pages.join(repeated.select(url), url, "left_anti")
    chosen = pages.join(repeated, url).filter(F.col(latest).eqNullSafe(F.col("_latest"))).drop("_latest").dropDuplicates([url])
    return single.unionByName(chosen)


def resolve_pages(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Give every seed the stored HTML of its URL; NULL html means no page.

    Pages nobody asks for are left behind first, so their HTML is moved only
    where the list itself is too large to broadcast.  A URL may be listed any
    number of times: the join is safe for hot URLs.
    """
    asked = seeds.select("url").distinct()
    stored = one_per_url(pages.select("url", "page_id", "html").join(asked, "url", "left_semi"))
    return skew_join(seeds, stored, ["url"], "left").withColumn(
        "status", F.when(F.col("html").isNull(), F.lit("no_page")).otherwise(F.lit("ok"))
    )
