"""Repeated blocks across the pages of a host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions import urls as U
from leafpress.operators.extract import all_blocks
from leafpress.operators.skew import skew_join


def host_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, block_no, host, text, key)``: the text blocks with their host.

    ``key`` is a 128-bit hash of the lower-cased text, so no text is shuffled to
    count or to join.
    """
    return (
        pages.filter(F.col("html").isNotNull())
        .select("page_id", U.netloc(F.col("url")).alias("host"), F.posexplode(all_blocks("html")).alias("block_no", "b"))
        .select("page_id", "block_no", "host", F.col("b.text").alias("text"), F.md5(F.lower("b.text")).alias("key"))
    )


def host_boilerplate(table: DataFrame, min_pages: int = 3) -> DataFrame:
    """Texts which occur on at least ``min_pages`` pages of one host.

    Counted over (host, text) after one row per page and text, both with partial
    aggregation, so neither a large host nor a text found everywhere is a
    hot group.  Texts, in lower case, are picked up for the reported rows alone.
    """
    found = _repeated(table, min_pages)
    texts = table.join(found.select("host", "key"), ["host", "key"], "left_semi")
    texts = texts.groupBy("host", "key").agg(F.min(F.lower("text")).alias("text"))
    return found.join(texts, ["host", "key"])


def _repeated(table: DataFrame, min_pages: int) -> DataFrame:
    once = table.select("host", "key", "page_id").distinct()
    return once.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)


def drop_host_boilerplate(table: DataFrame, min_pages: int = 3) -> DataFrame:
    """Blocks whose text is no boilerplate of their host.

    ``table`` is read three times: write the blocks out before, cutting pages
    into blocks costs far more than reading them back.
    """
    return skew_join(table, _repeated(table, min_pages).select("host", "key"), ["host", "key"], "left_anti")
