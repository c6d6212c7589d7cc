"""Stored pages by URL: a table that is bucketed once, and looked up without being moved.

A walk asks for the pages of a few URLs at each level.  ``write_store`` puts one row for each
URL into buckets by the hash of the URL, sorted within.  ``look_up`` then finds the rows of a
table of distinct URLs: up to ``FEW`` of them become a filter, by which the scan leaves out
all other buckets; more of them are dealt like the store and joined bucket by bucket.  Either
way the store has no exchange.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.session import ensure_checkpoint_dir
from leafpress.sources.pages import one_per_url

#: URLs that are looked up by a filter; they pass through the driver.
FEW = 1000


class UrlStore:
    """A bucketed table of pages, one row for each URL; lives until ``drop``."""

    def __init__(self, spark: SparkSession, name: str, buckets: int, path: str):
        self.spark, self.name, self.buckets, self.path = spark, name, buckets, path

    @property
    def pages(self) -> DataFrame:
        return self.spark.table(self.name)

    def look_up(self, urls: DataFrame) -> DataFrame:
        """Rows of the store whose URL is among ``urls``, a table of distinct ones with the column ``url``."""
        few = [r.url for r in urls.select("url").limit(FEW + 1).collect()]
        if len(few) <= FEW:
            return self.pages.filter(F.col("url").isin([u for u in few if u is not None]))
        dealt = urls.select("url").repartition(self.buckets, "url")
        return self.pages.join(dealt, "url", "left_semi")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_store(pages: DataFrame, buckets: int | None = None, path: str | None = None) -> UrlStore:
    """Write pages into a store; of pages stored twice the latest is kept (``one_per_url``).

    ``buckets`` should make files of some hundred MB; the default is the number of shuffle
    partitions.  Without ``path`` the store lies in the checkpoint folder.
    """
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"url_store_{uuid.uuid4().hex}"
    path = path or f"{ensure_checkpoint_dir(spark)}/{name}"
    dealt = one_per_url(pages).repartition(buckets, "url")  # a file for each bucket
    dealt.write.bucketBy(buckets, "url").sortBy("url").option("path", path).format("parquet").saveAsTable(name)
    return UrlStore(spark, name, buckets, path)
