"""Final text of a result: front matter, header lines, format dispatch, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions.names import format_name, output_filename
from leafpress.operators.images import localize_images
from leafpress.operators.skew import ranked
from leafpress.session import cut_lineage
from leafpress.sources.file_sink import host_folder

# Order and labels of the metadata lines.
FRONT_MATTER = (
    ("title", "title"), ("author", "author"), ("date", "date"), ("url", "url"), ("sitename", "site"),
    ("description", "description"), ("language", "language"), ("categories", "categories"), ("tags", "tags"),
)
HEADER = (
    ("title", "Title"), ("author", "Author"), ("date", "Date"), ("url", "URL"), ("sitename", "Site"),
    ("description", "Description"), ("language", "Language"), ("categories", "Categories"), ("tags", "Tags"),
)
LISTS = ("categories", "tags")


def _lines(meta: Column, labels, fields, brackets: bool) -> list[Column]:
    out = []
    for field, label in labels:
        if field not in fields:
            continue
        value = meta[field]
        if field in LISTS:
            shown = F.array_join(value, ", ")
            shown = F.concat(F.lit("["), shown, F.lit("]")) if brackets else shown
            out.append(F.when(F.size(value) > 0, F.concat(F.lit(f"{label}: "), shown)))
        else:
            out.append(F.concat(F.lit(f"{label}: "), value))
    return out


def _with_head(content: Column, meta: Column, rule: str, lines: list[Column]) -> Column:
    # concat_ws leaves NULL lines out, so an absent field prints nothing
    whole = F.concat_ws("\n", F.lit(rule), *lines, F.lit(rule), F.lit(""), content)
    return F.when(meta.isNull(), content).otherwise(whole)


DEFAULT_FIELDS = ("title", "author", "date", "sitename", "description", "language", "categories", "tags")


def as_markdown(content: Column, meta: Column, fields=DEFAULT_FIELDS) -> Column:
    """Content under front matter; the content alone where there is no metadata."""
    return _with_head(content, meta, "---", _lines(meta, FRONT_MATTER, fields, brackets=True))


def as_text(content: Column, meta: Column, fields=DEFAULT_FIELDS) -> Column:
    return _with_head(content, meta, "=" * 60, _lines(meta, HEADER, fields, brackets=False))


def render(results: DataFrame, output_format: str = "markdown", with_metadata: bool = True, out: str = "document") -> DataFrame:
    """Add the text to write for each result.

    JSON, XML and CSV content is final already.  Markdown gets local image links
    where ``image_mappings`` is there, and front matter; text gets its header.
    Aliases mean the same format everywhere, an unknown name Markdown.
    """
    fmt = format_name(output_format)
    content = F.col("content")
    meta = F.col("metadata") if with_metadata and "metadata" in results.columns else None
    if fmt in ("json", "xml", "csv"):
        return results.withColumn(out, content)
    if fmt == "markdown":
        if "image_mappings" in results.columns:
            content = localize_images(content, F.col("image_mappings"))
        return results.withColumn(out, as_markdown(content, meta) if meta is not None else content)
    return results.withColumn(out, as_text(content, meta) if meta is not None else content)


def _numbered(results: DataFrame, order: list[str], also: list[str], output_format: str, with_metadata: bool, number: str) -> DataFrame:
    """The documents with their place in ``order``, which is unique and not null.

    They are written once; only the order columns are ranked, and the number is joined back.
    """
    rendered = render(results.filter("status = 'ok'"), output_format, with_metadata)
    written = cut_lineage(rendered.select(*dict.fromkeys([*order, *also]), "document"))
    return written.join(ranked(written.select(*order), [], order, number), order)


def named_documents(results: DataFrame, order: list[str], output_format: str = "markdown", with_metadata: bool = True) -> DataFrame:
    """``(filename, document)`` per successful page, numbered from 0 in ``order``."""
    numbered = _numbered(results, order, ["url"], output_format, with_metadata, "_n")
    name = output_filename(F.col("_n") - 1, F.col("url"), F.lit(output_format))
    return numbered.select(name.alias("filename"), "document")


def document_files(results: DataFrame, order: list[str], output_format: str = "markdown", with_metadata: bool = True) -> DataFrame:
    """The same documents as files ``(folder, filename, bytes)``, parted by host, for ``sources.file_sink``."""
    numbered = _numbered(results, order, ["url"], output_format, with_metadata, "_n")
    name = output_filename(F.col("_n") - 1, F.col("url"), F.lit(output_format))
    return numbered.select(host_folder(F.col("url")).alias("folder"), name.alias("filename"), F.col("document").cast("binary").alias("bytes"))


def combined_document(results: DataFrame, order: list[str], output_format: str = "markdown", with_metadata: bool = True) -> DataFrame:
    """All successful pages as one document, as parts ``(part_no, part)``.

    Put together in order the parts are the document; every part but the first
    starts with the line of 60 '='.  It stays a distributed table.
    """
    numbered = _numbered(results, order, [], output_format, with_metadata, "part_no")
    lead = F.when(F.col("part_no") == 1, F.lit("")).otherwise(F.lit("\n\n" + "=" * 60 + "\n\n"))
    return numbered.select("part_no", F.concat(lead, "document").alias("part"))
