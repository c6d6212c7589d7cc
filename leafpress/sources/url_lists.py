"""URL list files: one URL, file path, comment or blank per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.functions.arrays import strip


def read_url_lists(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of text files; LF, CRLF and CR end a line.

    A large file is read in many splits.  Line numbers come from the position
    within a split plus the lines of the splits before it, so no file passes
    through one task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return lines.join(splits, ["file", "_start"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line"
    )


def lines_of(files: DataFrame) -> DataFrame:
    """``(file, line_no, line)`` of texts held in a ``(file, text)`` table."""
    body = F.regexp_replace("text", r"(?:\r\n|\r|\n)\z", "")
    return files.filter(F.length("text") > 0).select(
        "file", F.posexplode(F.split(body, r"\r\n|\r|\n", -1)).alias("_pos", "line")
    ).select("file", (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def classify_lines(lines: DataFrame) -> DataFrame:
    """Strip each line and give it a status: ok, blank, comment or rejected."""
    text = F.col("line")
    return lines.withColumn("line", strip(text)).withColumn(
        "status",
        F.when(text == "", F.lit("blank"))
        .when(text.startswith("#"), F.lit("comment"))
        .when(text.rlike(r"^(?:https?://|file://|/)"), F.lit("ok"))
        .otherwise(F.lit("rejected")),
    )


def url_lines(lines: DataFrame) -> DataFrame:
    """The usable lines, as ``(file, line_no, url)``."""
    return classify_lines(lines).filter("status = 'ok'").select("file", "line_no", F.col("line").alias("url"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines which look like nothing that can be read, with their numbers."""
    return classify_lines(lines).filter("status = 'rejected'").select("file", "line_no", "line")


def list_summary(lines: DataFrame) -> DataFrame:
    """Per file whether it holds any URL, and a message with the count."""
    n = F.col("n_urls")
    return (
        classify_lines(lines)
        .groupBy("file")
        .agg(F.count_if(F.col("status") == "ok").alias("n_urls"))
        .select(
            "file",
            (n > 0).alias("ok"),
            F.when(n > 0, F.concat(F.lit("Found "), n.cast("string"), F.lit(" URLs in batch file")))
            .otherwise(F.lit("Batch file contains no valid URLs"))
            .alias("message"),
        )
    )
