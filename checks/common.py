"""Reading the given tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows for which a table gets another task, and pages, which are longer.
ROWS = 100_000
PAGES = 10_000


def spread_table(spark: SparkSession, sf: str, name: str, key: str, rows: int = ROWS) -> DataFrame:
    """The table, its rows dealt over a task for each core and for each ``rows`` rows, if a split holds over twice its share.

    Splits say little: all rows of a row group fall to one split, and a file of 128 MB may be one group.  The counts
    are read from the files' footers.
    """
    from leafpress.sources.pages import spread

    t = table(spark, sf, name)
    most, total = t.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total or 0) // rows))
    return t if (most or 0) <= 2 * (total or 0) / tasks else spread(t, tasks, key)


def with_folder(query):
    """Give a local session a folder for checkpoints, if it names none; clusters have to."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        sc = spark.sparkContext
        if sc.master.startswith("local[") and not sc.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="leafpress-"))
        return query(spark, sf)

    return run


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages, spread over tasks where the file has few row groups; where it has many, nothing is moved."""
    return spread_table(spark, sf, "pages", "page_id", PAGES)
