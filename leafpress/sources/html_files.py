"""Local HTML files as pages, and extraction from them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.operators.extract import extract_pages
from leafpress.session import few_tasks

_GLOB = re.compile(r"[*?\[\]{}\\]")


def _path(column: Column) -> Column:
    return F.regexp_replace(column, r"^file:/*", "/")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(value, path)`` of the files, the path still encoded.

    Spark looks at every file that a pattern in a path gives for itself, a third of a
    millisecond each in the driver; so a pattern for the files of one folder
    becomes a filter on the names in that folder.
    """
    folder, _, names = path.rpartition("/")
    if folder and _GLOB.search(names) and not _GLOB.search(folder):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(where):
            # no columns are read from names of folders within, and files there are left out
            depth = store.makeQualified(where).toString().removeprefix("file:").count("/") + 1
            found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(folder, wholetext=True)
            found = found.select("value", _path(F.col("_metadata.file_path")).alias("path"))
            found = found.filter(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) == depth)
            if not found.isEmpty():
                return found
    return spark.read.text(path, wholetext=True).select("value", _path(F.col("_metadata.file_path")).alias("path"))


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, file, url, html)``, one row per file; a missing path raises.

    A pattern in the last part of ``path`` stands for files of that folder, not of folders within.

    ``file`` is the absolute path, decoded.  ``url`` is NULL: a file has no address.
    ``page_id`` is a 64-bit hash of the path, for joins among some millions of
    files; where there are billions, ``file`` is the key.
    """
    name = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return few_tasks(_texts(spark, path)).select(
        F.xxhash64(name).alias("page_id"), name.alias("file"), F.lit(None).cast("string").alias("url"), F.col("value").alias("html")
    )


def extract_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Extraction results of local files, with ``file`` in place of ``url``."""
    return extract_pages(read_html_files(spark, path), **options).drop("url")
