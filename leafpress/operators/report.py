"""What a crawl or a batch run amounts to: counts, progress, joined documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import urls as U


def crawl_count(results: DataFrame) -> DataFrame:
    """Pages per seed."""
    return results.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_pages"))


def crawl_urls(results: DataFrame) -> DataFrame:
    return results.filter(F.coalesce("url", F.lit("")) != "").select("seed_id", "crawl_order", "url")


def by_depth(results: DataFrame, depth: int) -> DataFrame:
    return results.filter(F.col("crawl_depth") == depth)


def page_header(order: Column, depth: Column, url: Column, markdown: bool = True) -> Column:
    line = F.concat(F.lit("Page "), order.cast("string"), F.lit(" (Depth "), depth.cast("string"), F.lit("): "), url)
    if markdown:
        return F.concat(F.lit("\n\n# "), line, F.lit("\n\n"))
    return F.concat(F.lit("\n\n"), line, F.lit("\n" + "=" * 50 + "\n\n"))


def crawl_document(results: DataFrame, output_format: str = "markdown") -> DataFrame:
    """The joined document of a crawl as parts ``(seed_id, part_no, part)``.

    The parts of a seed, put together in order, are the document: each holds its
    header and the line break that follows the part before it.  A crawl of any
    size stays a distributed table and is not gathered into one value.  ``results`` are those of
    whole walks: the page of order 1 is there and opens the document.
    """
    full = F.coalesce("content", F.lit("")) != ""
    order, depth = F.coalesce("crawl_order", F.lit(0)), F.coalesce("crawl_depth", F.lit(0))
    header = page_header(order, depth, F.coalesce("url", F.lit("Unknown URL")), output_format == "markdown")
    # a walk numbers its extracted pages from 1, and each of them has content
    lead = F.when(order <= 1, F.lit("")).otherwise(F.lit("\n"))
    return results.filter(full).select("seed_id", F.col("crawl_order").alias("part_no"), F.concat(lead, header, "content").alias("part"))


def crawl_summary(results: DataFrame) -> DataFrame:
    """Summary of each crawl as rows ``(seed_id, item, key, value, n)``.

    Items: ``total_pages`` (n), ``depth`` (key = depth, n pages), ``domain``
    (value = host, n pages) and ``title`` (key = crawl order, value = title).
    Rows, not arrays, since a crawl may hold any number of hosts and titles.
    """
    none = F.lit(None).cast("string")
    depth = F.coalesce("crawl_depth", F.lit(0))

    def counted(item: str, key: Column, value: Column, rows: DataFrame) -> DataFrame:
        return rows.groupBy("seed_id", key.cast("long").alias("key"), value.alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        ).select("seed_id", F.lit(item).alias("item"), "key", "value", "n")

    has_url = results.filter(F.coalesce("url", F.lit("")) != "")
    titles = results.filter(F.coalesce("title", F.lit("")) != "").select(
        "seed_id", F.lit("title").alias("item"), F.col("crawl_order").cast("long").alias("key"),
        F.col("title").alias("value"), F.lit(1).cast("long").alias("n"),
    )
    return (
        counted("total_pages", F.lit(None), none, results)
        .unionByName(counted("depth", depth, none, results))
        .unionByName(counted("domain", F.lit(None), U.netloc(F.col("url")), has_url))
        .unionByName(titles)
    )


def progress(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of a run; status NULL means not done yet.

    ``success_rate`` is of the completed, ``percentage`` of all, and both are 0
    where there is nothing to divide by.
    """
    done = F.col("completed")
    rate = F.when(done > 0, (done - F.col("failed")) / done * 100).otherwise(0.0)
    percentage = F.when(F.col("total") > 0, done / F.col("total") * 100).otherwise(0.0)
    return (
        results.groupBy(*(by or []))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count("status").alias("completed"),
            F.count_if(F.col("status") != "ok").alias("failed"),
        )
        .withColumn("success_rate", rate)
        .withColumn("percentage", percentage)
    )


def observe_progress(results: DataFrame, name: str = "progress"):
    """Count rows and failures while the job runs: returns (DataFrame, Observation)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    watched = results.observe(
        seen, F.count(F.lit(1)).alias("completed"), F.count_if(F.col("status") != "ok").alias("failed")
    )
    return watched, seen
