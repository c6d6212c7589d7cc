"""File names for images and for written pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions import urls as U
from leafpress.functions.arrays import let

# Accepted format names, and the file ending of each format.
FORMATS = {
    "markdown": "markdown", "md": "markdown", "text": "txt", "txt": "txt",
    "xml": "xml", "json": "json", "csv": "csv",
}
ENDINGS = {"markdown": ".md", "txt": ".txt", "xml": ".xml", "json": ".json", "csv": ".csv"}

_NOT_WORD = r"[^\p{L}\p{N}_.\-]"


def format_name(name: str) -> str:
    """Output format for a name or alias; an unknown name means markdown."""
    return FORMATS.get(name.lower(), "markdown")


def canonical_format(name: Column) -> Column:
    """As :func:`format_name`, for a column of names."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit("markdown"))


def image_filename(url: Column) -> Column:
    """``name_<8 hex digits>.ext`` from the URL's last path part and its md5."""

    def build(path: Column) -> Column:
        last = F.when(path == "", F.lit("image")).otherwise(F.regexp_extract(path, r"([^/]*)/*$", 1))
        return let(last, lambda base: assemble(base))

    def assemble(base: Column) -> Column:
        dotted = F.contains(base, F.lit("."))
        name = F.when(dotted, F.regexp_extract(base, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(base)
        ext = F.when(dotted, F.regexp_extract(base, r"\.([^.]*)$", 1)).otherwise(F.lit("jpg"))
        clean_ext = F.substr(F.regexp_replace(F.lower(ext), r"[^\p{L}\p{N}_]", ""), F.lit(1), F.lit(10))
        return F.concat(
            F.substr(F.regexp_replace(name, _NOT_WORD, "_"), F.lit(1), F.lit(50)),
            F.lit("_"), F.substr(F.md5(url.cast("binary")), F.lit(1), F.lit(8)), F.lit("."),
            F.when(clean_ext == "", F.lit("jpg")).otherwise(clean_ext),
        )

    return let(U.path(url), build)


def output_filename(index: Column, url: Column, output_format: Column) -> Column:
    """``NNN_host_path.ext``: at most 150 characters before the ending, ``.txt`` for an unknown format."""
    host = F.replace(U.netloc(url), F.lit("www."), F.lit(""))
    path = F.regexp_replace(U.path(url), r"^/+|/+$", "")
    flat = F.replace(F.regexp_replace(path, r"[^\p{L}\p{N}_./\-]", "_"), F.lit("/"), F.lit("_"))
    digits = index.cast("string")
    number = F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), "0")
    base = F.concat(number, F.lit("_"), host, F.when(path == "", F.lit("")).otherwise(F.concat(F.lit("_"), flat)))
    endings = F.create_map(*[F.lit(x) for name, fmt in FORMATS.items() for x in (name, ENDINGS[fmt])])
    return F.concat(F.substr(base, F.lit(1), F.lit(150)), F.coalesce(F.try_element_at(endings, F.lower(output_format)), F.lit(".txt")))
