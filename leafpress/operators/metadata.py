"""Page metadata from the title, meta tags, JSON-LD and the html tag, inside the row.

Sources of a field, the first that has it wins: the page's own tags (the title, then the names of
``META_NAMES``; ``<html lang>`` for the language), then its JSON-LD scripts
(:mod:`leafpress.functions.json_ld`), for the title at last the first heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import html as H
from leafpress.functions import urls as U
from leafpress.functions import json_ld
from leafpress.functions.arrays import built_once, collapse_spaces, first_by, let
from leafpress.operators.language import declared_language

# Where each field is looked for, first hit wins.
META_NAMES = {
    "author": ("author", "article:author", "dc.creator", "citation_author"),
    "date": ("article:published_time", "date", "dc.date", "datepublished", "citation_date"),
    "description": ("description", "og:description", "twitter:description", "dc.description"),
    "sitename": ("og:site_name", "application-name"),
    "categories": ("article:section", "category"),
    "tags": ("keywords", "article:tag", "news_keywords"),
}
FIELDS = ("title", "author", "date", "description", "sitename", "hostname", "language", "categories", "tags")


def _items(value: Column) -> Column:
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts)


def _meta_map(head: Column) -> Column:
    """First non-empty content of each meta name, as a map."""
    entries = F.transform(
        H.elements(head, "meta"),
        lambda t: let(
            H.attributes(t),
            lambda a: F.struct(
                F.lower(F.trim(H.pick(a, "(?:name|property|itemprop)"))).alias("k"), H.pick(a, "content").alias("v")
            ),
        ),
    )
    useful = F.filter(entries, lambda e: e["k"].isNotNull() & (F.trim(e["v"]) != ""))
    return F.map_from_entries(first_by(useful, lambda e: e["k"]))


def page_metadata(html: Column, url: Column | None = None) -> Column:
    """Struct of the nine fields, NULL where absent and NULL if all are.

    Only the part of the page before ``<body>`` is searched for meta tags if
    there is such a tag, so a long body is not scanned again.  A ``<body>`` within a
    script or comment is none.  JSON-LD is read from the whole page.
    """

    def build(whole: Column, head: Column, metas: Column, told: Column) -> Column:
        def first(*names: str) -> Column:
            return F.coalesce(*[F.try_element_at(metas, F.lit(n)) for n in names])

        title = F.regexp_extract(head, rf"(?is){H.tag_pattern('title')}(.*?)(?:</title|\z)", 1)
        heading = F.regexp_extract(whole, rf"(?is){H.tag_pattern('h1')}(.*?)</h1", 1)
        raw = F.array(
            title, first("og:title", "twitter:title"), H.strip_tags(heading),
            *[first(*names) for names in META_NAMES.values()],
        )
        filled = F.transform(raw, lambda x: F.nullif(collapse_spaces(H.decode_entities(x)), F.lit("")))
        return let(filled, lambda v: fields(head, v, told))

    def fields(head: Column, v: Column, told: Column) -> Column:
        named = {f: F.get(v, i + 3) for i, f in enumerate(META_NAMES)}
        host = F.nullif(U.netloc(url), F.lit("")) if url is not None else F.lit(None).cast("string")
        return F.struct(
            F.coalesce(F.get(v, 0), F.get(v, 1), told["title"], F.get(v, 2)).alias("title"),
            *[F.coalesce(named[f], told[f]).alias(f) for f in ("author", "date", "description", "sitename")],
            host.alias("hostname"),
            F.coalesce(declared_language(head), told["language"]).alias("language"),
            *[F.coalesce(_items(named[f]), told[f]).alias(f) for f in ("categories", "tags")],
        )

    def read(whole: Column, told: Column) -> Column:
        before = F.regexp_replace(whole, r"(?is)<body[\s>].*\z", "")
        return let(before, lambda head: let(_meta_map(head), lambda metas: build(whole, head, metas, told)))

    full = let(H.strip_hidden(html), lambda whole: let(json_ld.structured(html), lambda told: read(whole, told)))
    return let(full, lambda m: F.when(F.coalesce(*[m[f].cast("string") for f in FIELDS]).isNotNull(), m))


@built_once
def metadata_of(html: str, url: str | None = None) -> Column:
    return page_metadata(F.col(html), None if url is None else F.col(url))


def metadata_table(pages: DataFrame) -> DataFrame:
    """One row per page with the metadata fields as columns."""
    return pages.select("page_id", metadata_of("html", "url").alias("m")).select("page_id", "m.*")


def json_ld_table(pages: DataFrame) -> DataFrame:
    """One row per page with JSON-LD scripts: how many there are, how many are broken, and what the others say."""
    told = pages.select("page_id", F.explode(F.array(json_ld.structured(F.col("html")))).alias("m"))
    return told.filter("m is not null").select("page_id", "m.*")
