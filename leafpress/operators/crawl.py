"""Breadth-first walk of stored pages, many seeds at once.

Taking URLs from a queue visits them level by level, so each level is one step
over DataFrames.  The driver only sees whether a level is empty.  Rules:

* a seed has depth 0, links of a page at depth d have depth d + 1 up to
  ``max_depth``; within a level the order is parent order, then link position;
* a URL is handled once per seed, at its first place;
* only the seed's host is followed with ``same_domain_only``; robots rules apply
  to every URL, the seed too;
* a page that is missing or empty is visited, but neither counted nor followed;
* the walk of a seed ends once ``max_pages`` pages were extracted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions import urls as U
from leafpress.operators.extract import extract_pages
from leafpress.operators.links import page_links
from leafpress.operators.robots import allowed_only
from leafpress.operators.skew import running, skew_join, sliced
from leafpress.session import cut_lineage, shuffle_width
from leafpress.sources.pages import one_per_url
from leafpress.sources.store import UrlStore


def page_index(pages: DataFrame, **options) -> DataFrame:
    """``(url, ok, links)`` per page: whether it has content and where it links.

    ``pages`` holds one row per URL.
    """
    with_links = pages.withColumn("links", page_links("html", "url"))
    return extract_pages(with_links, with_metadata=False, **options).select(
        "url", (F.col("status") == "ok").alias("ok"), "links"
    )


def next_frontier(candidates: DataFrame, visited: DataFrame | None) -> DataFrame:
    """First place of every new URL per seed.

    Grouping and anti join are on (seed, URL), so a seed with a large share of
    the links is spread over all tasks.
    """
    first = (
        candidates.groupBy("seed_id", "seed_host", "url")
        .agg(F.min(F.struct("parent_order", "pos")).alias("place"))
        .select("seed_id", "seed_host", "url", "place.parent_order", "place.pos")
    )
    return first if visited is None else first.join(visited, ["seed_id", "url"], "left_anti")


def follow(level: DataFrame, same_domain_only: bool = True) -> DataFrame:
    """Links of the extracted pages of a level, as candidates of the next."""
    out = level.filter("counted").select(
        "seed_id", "seed_host", F.col("order_in_level").alias("parent_order"), F.posexplode("links").alias("pos", "url")
    )
    return out.filter(U.netloc(F.col("url")) == F.col("seed_host")) if same_domain_only else out


Index = DataFrame | Callable[[DataFrame], DataFrame]


def _look_up(frontier: DataFrame, index: Index) -> DataFrame:
    """Join the frontier with the index: each URL once, then back to the seeds.

    The index is by far the larger side and stays where it is (it is partitioned
    by URL); URLs wanted by many seeds only meet the few rows of this level.
    """
    urls = frontier.select("url").distinct()
    wanted = index(urls) if callable(index) else urls.join(index, "url")
    return skew_join(frontier, wanted, ["url"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def crawl(
    index: Index,
    seeds: DataFrame,
    max_depth: int = 1,
    max_pages: int | None = 10,
    same_domain_only: bool = True,
    robots: DataFrame | None = None,
) -> DataFrame:
    """Every visited URL: ``(seed_id, url, crawl_depth, crawl_order, status)``.

    ``index`` comes from :func:`page_index`, or is a function that gives the rows of
    one for a table of distinct URLs; ``seeds`` is ``(seed_id, url)``.
    ``crawl_order`` counts the extracted pages of a seed from 1 and is NULL for
    status 'failed'.
    """
    if not callable(index):
        index = cut_lineage(index.repartition(shuffle_width(index.sparkSession), "url"), keep_partitioning=True)
    frontier = seeds.select(
        "seed_id", U.netloc(F.col("url")).alias("seed_host"), "url",
        F.lit(0).cast("long").alias("parent_order"), F.lit(0).alias("pos"),
    )
    levels: list[DataFrame] = []
    for depth in range(max_depth + 1):
        frontier = next_frontier(frontier, _union([x.select("seed_id", "url") for x in levels]))
        if robots is not None:
            frontier = allowed_only(frontier, robots)
        # used for the lookup, for its heavy keys and for the join back
        frontier = cut_lineage(frontier)
        done = _union([x.filter("counted").select("seed_id") for x in levels])
        if done is None or max_pages is None:
            frontier = frontier.withColumn("before", F.lit(0).cast("long"))
        else:
            counts = done.groupBy("seed_id").agg(F.count(F.lit(1)).alias("before"))
            frontier = skew_join(frontier, counts, ["seed_id"], "left").fillna(0, ["before"])
            frontier = frontier.filter(F.col("before") < max_pages)
        level = _rank_level(_look_up(frontier, index), max_pages).withColumn("crawl_depth", F.lit(depth))
        level = cut_lineage(level)
        levels.append(level)
        if level.isEmpty():
            break
        frontier = follow(level, same_domain_only)
    return _number(levels)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def _rank_level(found: DataFrame, max_pages: int | None) -> DataFrame:
    """Place of each page among the extracted ones of its level; cut at the cap."""
    order = ["parent_order", "pos"]
    slices = sliced(found.withColumn("_ok", F.col("ok").cast("long")), ["seed_id"], order)
    ranked = running(slices, ["seed_id"], order, "_ok", "order_in_level", "sum")
    if max_pages is not None:
        # pages are tried until the cap is reached: failures before it are visited
        ranked = ranked.filter(F.col("before") + F.col("order_in_level") - F.col("_ok") < max_pages)
    return ranked.withColumn("counted", F.col("ok")).drop("_slice", "_ok", "ok")


def _number(levels: list[DataFrame]) -> DataFrame:
    """Crawl order over all levels: pages of earlier levels plus place in level."""
    visited = _union([x.select("seed_id", "url", "crawl_depth", "order_in_level", "counted") for x in levels])
    sizes = visited.filter("counted").groupBy("seed_id", "crawl_depth").agg(F.count(F.lit(1)).alias("n"))
    # one row per seed and depth: the depths of a seed are few
    other = sizes.select("seed_id", F.col("crawl_depth").alias("d"), "n")
    earlier = (
        sizes.select("seed_id", "crawl_depth").unionByName(visited.select("seed_id", "crawl_depth")).distinct()
        .join(other, "seed_id", "left")
        .groupBy("seed_id", "crawl_depth")
        .agg(F.coalesce(F.sum(F.when(F.col("d") < F.col("crawl_depth"), F.col("n"))), F.lit(0)).alias("earlier"))
    )
    return skew_join(visited, earlier, ["seed_id", "crawl_depth"], "left").select(
        "seed_id", "url", "crawl_depth",
        F.when(F.col("counted"), F.col("earlier") + F.col("order_in_level")).alias("crawl_order"),
        F.when(F.col("counted"), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
    )


def crawl_pages(
    pages: DataFrame | UrlStore,
    seeds: DataFrame,
    max_depth: int = 1,
    max_pages: int | None = 10,
    same_domain_only: bool = True,
    robots: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Extraction results of a crawl, with ``crawl_depth`` and ``crawl_order``.

    A level extracts the stored pages of its own URLs that no earlier level has
    extracted, so the work follows what the walk reaches and not the store.
    Results are written level by level, and joined with the visited URLs at the
    end.  Of pages stored twice one is read (``one_per_url``).  A plain table of pages is
    scanned for each level; a ``UrlStore`` is not moved, and levels of few URLs read their buckets only.
    """
    parts: list[DataFrame] = []

    def extracted(urls: DataFrame) -> DataFrame:
        known = _union(parts)
        new = urls if known is None else urls.join(known.select("url"), "url", "left_anti")
        stored = pages.look_up(new) if isinstance(pages, UrlStore) else one_per_url(pages.join(new, "url", "left_semi"))
        parts.append(cut_lineage(extract_pages(stored.withColumn("links", page_links("html", "url")), **options)))
        return urls.join(_union(parts).select("url", (F.col("status") == "ok").alias("ok"), "links"), "url")

    walked = crawl(extracted, seeds, max_depth, max_pages, same_domain_only, robots).filter("status = 'ok'").drop("status")
    return skew_join(walked, _union(parts).drop("links").join(walked.select("url").distinct(), "url", "left_semi"), ["url"], "inner")


def drop_failures(visited: DataFrame) -> DataFrame:
    return visited.filter("status = 'ok'")
