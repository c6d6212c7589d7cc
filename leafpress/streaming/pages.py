"""Extraction of pages as they land in a folder.

Extraction works inside the row, without shuffle or state, so the batch job runs
unchanged on a stream.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafpress.operators.extract import drop_failed, extract_pages

PAGE_SCHEMA = "page_id bigint, url string, html string"


def extract_stream(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Read parquet files of pages as they arrive, write the results as parquet.

    ``checkpoint`` is a folder all executors reach; a restarted query goes on
    where it stopped and writes no page twice.
    """
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(source)
    results = drop_failed(extract_pages(pages, **options))
    writer = results.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(target)


def watched(results: DataFrame, name: str = "progress") -> DataFrame:
    """Count rows, done ones (with a status) and failures of each micro-batch while they are written."""
    return results.observe(
        name, F.count(F.lit(1)).alias("rows"), F.count("status").alias("completed"), F.count_if(F.col("status") != "ok").alias("failed")
    )


def live_progress(query: StreamingQuery, total: int | None = None, name: str = "progress", every: float = 0.1) -> Iterator[dict]:
    """A row of sums for each finished micro-batch of a query over ``watched`` rows, while it runs.

    Rows have ``batch``, ``total`` (as given, else the rows seen so far), ``completed``, ``failed``,
    ``success_rate`` and ``percentage``, as in ``report.progress``; the iterator ends with the query and raises
    what it failed with.  Only counts reach the driver.  Spark keeps the figures of the last
    ``spark.sql.streaming.numRecentProgressUpdates`` batches (100): if more pass between two looks, counts would be
    missing and RuntimeError is raised, so look often or raise that setting.
    """
    keeps = int(SparkSession.active().conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    last, rows, completed, failed = None, 0, 0, 0
    while True:
        active = query.isActive  # asked before the figures, so those of the last batch are not missed
        recent = [p for p in query.recentProgress if name in p["observedMetrics"]]
        new = [p for p in recent if last is None or p["batchId"] > last]
        if last is not None and len(new) == len(recent) >= keeps:
            raise RuntimeError("batches passed unseen: look more often, or have Spark keep more progress updates")
        for p in new:
            seen = p["observedMetrics"][name]
            last, rows, completed, failed = p["batchId"], rows + seen["rows"], completed + seen["completed"], failed + seen["failed"]
            of = rows if total is None else total
            yield {
                "batch": last, "total": of, "completed": completed, "failed": failed,
                "success_rate": (completed - failed) / completed * 100 if completed else 0.0, "percentage": completed / of * 100 if of else 0.0,
            }
        if not active:
            if query.exception() is not None:
                raise query.exception()
            return
        time.sleep(every)
