"""Whole runs over a URL list: read, expand, resolve, extract, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators.extract import drop_failed, extract_pages
from leafpress.operators.globs import expand_list
from leafpress.operators.images import found_images, image_files, save_images, with_image_mappings
from leafpress.operators.render import document_files, named_documents
from leafpress.operators.skew import skew_join
from leafpress.session import cut_lineage
from leafpress.sources.file_sink import write_files
from leafpress.sources.pages import one_per_url
from leafpress.sources.sinks import write_documents
from leafpress.sources.url_lists import classify_lines


def run_list(
    lines: DataFrame, pages: DataFrame, workers: int | None = None, ignore_glob: bool = False, outcome: DataFrame | None = None, **options
) -> DataFrame:
    """Results for every URL of the lists, in list order by (file, line_no, ordinal).

    The expanded list is written once, since it is used in three places.  A URL
    asked for many times is extracted once, and its result is joined back
    in a skew-safe way.  URLs without a stored page have status no_page; lines that
    are no URL, and patterns that cannot be counted, have status rejected and stand
    in ``url`` as they are.  Of pages stored twice, one is read (``one_per_url``).
    With ``workers``, extraction runs in at most so many tasks.  With
    ``extract_images``, results carry ``images`` and ``image_mappings`` of those that
    ``outcome`` (from ``fetch_outcome``) has as fetched.
    """
    marked = classify_lines(lines).filter(F.col("status").isin("ok", "rejected"))
    listed = marked.select("file", "line_no", F.col("line").alias("url"), F.col("status").alias("_line"))
    good = expand_list(listed.filter("_line = 'ok'").drop("_line"), ignore_glob=ignore_glob, keep_rejected=True)
    bad = listed.filter("_line = 'rejected'").select("file", "line_no", "url", F.lit(0).cast("long").alias("ordinal"), F.lit("rejected").alias("status"))
    asked = cut_lineage(good.unionByName(bad).withColumnRenamed("status", "_asked"))
    wanted = one_per_url(pages.join(asked.filter("_asked = 'ok'").select("url").distinct(), "url", "left_semi"))
    if workers:
        wanted = wanted.repartition(workers)
    results = extract_pages(wanted, **options)
    if "images" in results.columns:
        results = with_image_mappings(cut_lineage(results) if outcome is None else results, outcome)
    status = F.when(F.col("_asked") == "rejected", F.col("_asked")).otherwise(F.coalesce("status", F.lit("no_page")))
    return skew_join(asked, results, ["url"], "left").withColumn("status", status).drop("_asked")


def run_batch(
    lines: DataFrame, pages: DataFrame, out: str, output_format: str = "markdown", with_metadata: bool = True,
    blobs: DataFrame | None = None, images_out: str | None = None, as_files: bool = False, **options,
) -> DataFrame:
    """Run a list and write one named document per page; returns the good results.

    The results are written once to the checkpoint folder, and both the documents
    and what the caller does with them are made from that copy.  With
    ``extract_images`` the documents point at local images, and with ``blobs`` and
    ``images_out`` the images themselves are written as a table.  With ``as_files`` both are
    files of their own: documents in a folder for each host, images in the folder that documents point to.
    """
    good = cut_lineage(drop_failed(run_list(lines, pages, output_format=output_format, with_metadata=with_metadata, **options)))
    order = ["file", "line_no", "ordinal"]
    if blobs is not None and images_out and "images" in good.columns:
        if as_files:
            write_files(image_files(found_images(good), blobs), images_out)
        else:
            save_images(found_images(good), blobs, images_out)
    if as_files:
        write_files(document_files(good, order, output_format, with_metadata), out)
    else:
        write_documents(named_documents(good, order, output_format, with_metadata), out)
    return good
