"""Writing results: tables of documents, joined text, JSON, CSV and XML files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.functions.names import format_name
from leafpress.session import shuffle_width


def write_documents(documents: DataFrame, path: str) -> None:
    """A table with one row per document: ``(filename, document)``."""
    documents.write.mode("overwrite").parquet(path)


def write_parts(parts: DataFrame, path: str, order: str = "part_no", part: str = "part") -> None:
    """Text files which, read in the order of their names, are the document.

    Parts go to files by ranges of their number, so no task sees them all.
    """
    n = shuffle_width(parts.sparkSession)
    ordered = parts.repartitionByRange(n, F.col(order)).sortWithinPartitions(order)
    ordered.select(part).write.mode("overwrite").option("lineSep", "\x00").text(path)


def write_records(results: DataFrame, path: str, output_format: str = "json") -> None:
    """Results with flat metadata columns as JSON lines, CSV or XML files."""
    flat = results.select(
        "url",
        *[F.col(f"metadata.{c}").alias(c) for c in ("title", "author", "date", "description", "sitename", "hostname", "language")],
        *[F.array_join(F.col(f"metadata.{c}"), ";").alias(c) for c in ("categories", "tags")],
        "content",
    )
    writer = flat.write.mode("overwrite")
    output_format = format_name(output_format)
    if output_format == "json":
        writer.json(path)
    elif output_format == "csv":
        writer.csv(path, header=True, escape='"')
    elif output_format == "xml":
        writer.format("xml").option("rowTag", "doc").save(path)
    else:
        raise ValueError(f"no record format {output_format}")
