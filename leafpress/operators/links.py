"""Links of a page, read and cleaned inside the page's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import html as H
from leafpress.functions import urls as U
from leafpress.functions.arrays import built_once, let, strip


def hrefs(html: Column) -> Column:
    """Anchor targets in page order; empty, '#', javascript and mailto left out.

    Anchors in noscript and template elements count.
    """
    raw = F.transform(
        H.elements(H.strip_inert(html), "a"), lambda t: strip(H.decode_entities(H.attribute(t, "href")))
    )
    skipped = ("#", "javascript:", "mailto:")
    return F.filter(
        raw, lambda h: (h != "") & ~(h.startswith(skipped[0]) | h.startswith(skipped[1]) | h.startswith(skipped[2]))
    )


def clean_link(base: Column, href: Column) -> Column:
    """Absolute link without its fragment."""
    return _tidy(U.join(base, href))


def _tidy(url: Column) -> Column:
    return let(url, lambda u: U.lower_scheme(U.defragment(u)))


def links_of(html: Column, base: Column) -> Column:
    """Distinct crawlable links of a page, by first place on the page."""
    absolute = let(
        U.base_parts(base), lambda parts: F.transform(hrefs(html), lambda h: _tidy(U.resolve(parts, h)))
    )
    return F.array_distinct(F.filter(absolute, U.is_crawlable))


@built_once
def page_links(html: str, url: str) -> Column:
    return links_of(F.col(html), F.col(url))


def raw_link_table(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("pos", "href"))


def link_table(pages: DataFrame) -> DataFrame:
    """Edges ``(page_id, src_url, pos, dst_url)``; ``pos`` counts distinct links."""
    return pages.select(
        "page_id", F.col("url").alias("src_url"), F.posexplode(page_links("html", "url")).alias("pos", "dst_url")
    )
