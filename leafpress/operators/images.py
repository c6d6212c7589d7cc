"""Images of pages: finding, naming, fetch outcomes, and local links in content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import html as H
from leafpress.functions import urls as U
from leafpress.functions.arrays import built_once, first_by, free_names, let, replace_each
from leafpress.functions.names import image_filename
from leafpress.operators.skew import skew_join
from leafpress.session import cut_lineage

#: Folder that documents point to for their images.
IMAGE_FOLDER = "img"

# An image in Markdown, an image tag, and the source within it.
MARKDOWN_IMAGE = r"""!\[([^\]]*)\]\(([^)]+?)(\s+"[^"]*")?\)"""
IMAGE_TAG = r"<img[^>]+>"
TAG_SOURCE = r"""src=["']([^"']+)["']"""


def images_of(html: Column, page_url: Column) -> Column:
    """Images of a page in order: url, alt, title, local_filename, original_src.

    Images in noscript and template elements count, as lazily loaded ones often
    stand there.  Sources without text and data URLs are left out; the first of several images
    with one URL is kept.
    """

    def image(parts: Column, tag: Column) -> Column:
        def build(pairs: Column) -> Column:
            values = F.transform(
                F.array(*[H.pick(pairs, n) for n in ("src", "alt", "title")]), lambda v: H.decode_entities(v)
            )
            return let(
                values,
                lambda v: F.struct(
                    U.resolve(parts, F.get(v, 0)).alias("url"),
                    F.coalesce(F.get(v, 1), F.lit("")).alias("alt"),
                    F.coalesce(F.get(v, 2), F.lit("")).alias("title"),
                    F.get(v, 0).alias("original_src"),
                ),
            )

        return let(H.attributes(tag), build)

    def find(parts: Column) -> Column:
        found = F.transform(H.elements(H.strip_inert(html), "img"), lambda t: image(parts, t))
        usable = F.filter(
            found, lambda i: i["original_src"].isNotNull() & (i["original_src"] != "") & ~i["url"].startswith("data:")
        )
        return F.transform(
            first_by(usable, lambda i: i["url"]),
            lambda i: F.struct(
                i["url"].alias("url"), i["alt"].alias("alt"), i["title"].alias("title"),
                image_filename(i["url"]).alias("local_filename"), i["original_src"].alias("original_src"),
            ),
        )

    return let(U.base_parts(U.image_base(page_url)), find)


@built_once
def page_images(html: str, url: str) -> Column:
    return images_of(F.col(html), F.col(url))


def image_table(pages: DataFrame) -> DataFrame:
    """One row per image: ``(page_id, pos, url, alt, title, local_filename, original_src)``."""
    return pages.select("page_id", F.posexplode(page_images("html", "url")).alias("pos", "i")).select(
        "page_id", "pos", "i.*"
    )


def fetch_outcome(attempts: DataFrame, max_retries: int = 2) -> DataFrame:
    """Per URL: whether one of the first ``max_retries + 1`` attempts gave 200.

    ``attempts`` is ``(url, attempt, status)``; a NULL status is a network error.
    """
    good = F.coalesce(F.col("status") == 200, F.lit(False))
    return (
        attempts.filter(F.col("attempt") <= max_retries + 1)
        .groupBy("url")
        .agg(
            F.max(good).alias("ok"),
            F.coalesce(F.min(F.when(good, F.col("attempt"))), F.max("attempt")).alias("attempts"),
            F.max_by("status", "attempt").alias("last_status"),
        )
    )


def mapping_of(images: Column) -> Column:
    """Map from absolute URL and from original source to ``img/<name>``; later images win."""
    pairs = F.flatten(
        F.transform(
            images,
            lambda i: let(
                F.concat(F.lit(f"{IMAGE_FOLDER}/"), i["local_filename"]),
                lambda p: F.array(
                    F.struct(i["url"].alias("k"), p.alias("v")), F.struct(i["original_src"].alias("k"), p.alias("v"))
                ),
            ),
        )
    )
    return F.map_from_entries(first_by(F.reverse(pairs), lambda e: e["k"]))


def image_mapping(images: DataFrame, outcome: DataFrame | None = None, by: str = "page_id") -> DataFrame:
    """``(page_id, image_mappings)`` of the images that were fetched, or another column ``by`` that tells pages apart.

    An image such as a logo may be on any share of the pages, so it meets its
    outcome in a skew-safe join; what is gathered per page is the page's images.
    A join with the maps is a sort-merge join, as there are as many maps as pages
    and Spark takes them for smaller than they are.
    """
    if outcome is not None:
        images = skew_join(images, outcome.filter("ok").select("url"), ["url"], "left_semi")
    per_page = images.groupBy(by).agg(
        F.sort_array(F.collect_list(F.struct("pos", "url", "local_filename", "original_src"))).alias("i")
    )
    return per_page.select(by, mapping_of(F.col("i")).alias("image_mappings")).hint("merge")


def found_images(results: DataFrame, by: str = "page_id") -> DataFrame:
    """The image table of extraction results that carry ``images``."""
    return results.select(by, F.posexplode("images").alias("pos", "i")).select(by, "pos", "i.*")


def with_image_mappings(results: DataFrame, outcome: DataFrame | None = None) -> DataFrame:
    """Add ``image_mappings`` to extraction results that carry ``images``.

    Without ``outcome`` every image counts as fetched, and the map is made in the
    page's row.  Else only the narrow image table meets the outcomes, and each page
    gets its map back by the number of its row: ids may be null or repeat.
    """
    if outcome is None:
        return results.withColumn("image_mappings", mapping_of(F.col("images")))
    (row,) = free_names(results, "_row")
    numbered = cut_lineage(results.withColumn(row, F.monotonically_increasing_id()))
    return numbered.join(image_mapping(found_images(numbered, row), outcome, row), row, "left").drop(row)


def localize_markdown(content: Column, mapping: Column) -> Column:
    """Point ``![alt](url "title")`` at the local file where the URL is mapped."""

    def swap(hit: Column) -> Column:
        local = F.try_element_at(mapping, F.regexp_extract(hit, MARKDOWN_IMAGE, 2))
        return F.when(F.coalesce(local, F.lit("")) == "", hit).otherwise(
            F.concat(
                F.lit("!["), F.regexp_extract(hit, MARKDOWN_IMAGE, 1), F.lit("]("), local,
                F.regexp_extract(hit, MARKDOWN_IMAGE, 3), F.lit(")"),
            )
        )

    return replace_each(content, MARKDOWN_IMAGE, swap)


def localize_html(content: Column, mapping: Column) -> Column:
    """Point image tags in the content at the local file, all places in the tag."""

    def swap(hit: Column) -> Column:
        def put(src: Column) -> Column:
            local = F.try_element_at(mapping, src)
            return F.when((src == "") | (F.coalesce(local, F.lit("")) == ""), hit).otherwise(F.replace(hit, src, local))

        return let(F.regexp_extract(hit, TAG_SOURCE, 1), put)

    return replace_each(content, IMAGE_TAG, swap)


def localize_images(content: Column, mapping: Column) -> Column:
    both = localize_html(localize_markdown(content, mapping), mapping)
    return F.when(mapping.isNull() | ~content.rlike(r"!\[|<img"), content).otherwise(both)


def stored_images(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """``(local_filename, bytes)`` of fetched images, each URL once.

    ``blobs`` is ``(url, bytes)``, one row per URL, as landed by a fetcher.
    """
    return images.select("url", "local_filename").distinct().join(blobs.select("url", "bytes"), "url").drop("url")


def save_images(images: DataFrame, blobs: DataFrame, path: str) -> None:
    stored_images(images, blobs).write.mode("overwrite").parquet(path)


def image_files(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """The stored images as files ``(folder, filename, bytes)``; the folder is the one that documents point to."""
    return stored_images(images, blobs).select(F.lit(IMAGE_FOLDER).alias("folder"), F.col("local_filename").alias("filename"), "bytes")
