"""URL expressions: parts, joining, cleaning and the crawlable test.

``parse_url`` is not used because it gives NULL for URLs that hold spaces or
brackets, which URL lists do hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions.arrays import let

# File endings that a crawl does not follow.
SKIPPED_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "tar", "gz", "exe", "dmg",
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "ico",
    "mp3", "mp4", "avi", "mov", "wmv", "flv",
    "css", "js", "xml", "rss", "json",
)

# Endings which mark a base URL as a file, not a folder.
FILE_LIKE_ENDINGS = (".html", ".htm", ".php", ".asp", ".jsp")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    """Lower-case scheme, '' if there is none."""
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    """Host with port and user part, '' if there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, _ORIGIN, 1)


def path(url: Column) -> Column:
    """Path without query, fragment or the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def has_scheme_and_host(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")


def source_kind(source: Column) -> Column:
    """'url' for http, https and file URLs, otherwise 'path'."""
    return F.when(source.rlike(r"^(?:https?|file)://"), F.lit("url")).otherwise(F.lit("path"))


def defragment(url: Column) -> Column:
    """Drop the fragment (and an empty query), keep query and parameters.

    A query is empty if the first ``?`` is the last character.
    """
    bare = F.substring_index(url, "#", 1)
    return F.when((bare != "") & (F.instr(bare, "?") == F.length(bare)), F.substr(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def is_crawlable(url: Column) -> Column:
    """http or https, a host, and not a file ending from the fixed list."""
    endings = "|".join(SKIPPED_EXTENSIONS)
    is_file = url.rlike(rf"(?i)^[a-z]+://[^/?#]*/[^?#]*\.(?:{endings})(?:;[^/?#]*)?(?:[?#]|$)")
    return url.rlike(r"^(?i:https?)://[^/?#]") & ~is_file


def image_base(url: Column) -> Column:
    """Base for image sources: a folder gets a closing slash, a file does not."""
    endings = "|".join(e.lstrip(".") for e in FILE_LIKE_ENDINGS)
    is_folder = ~url.endswith("/") & ~path(url).rlike(rf"\.(?:{endings})$")
    return F.when(is_folder, F.concat(url, F.lit("/"))).otherwise(url)


def _merge_path(base_path: Column, ref_path: Column) -> Column:
    """Resolve a path reference against the base path, dot segments removed."""
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    squeezed = F.regexp_replace(F.concat(folder, ref_path), r"/{2,}", "/")
    full = F.when(ref_path.startswith("/"), ref_path).otherwise(
        F.when(squeezed.startswith("/"), squeezed).otherwise(F.concat(F.lit("/"), squeezed))
    )
    return F.when(~full.rlike(r"/\.\.?(?:/|$)"), full).otherwise(_drop_dots(full))


def _drop_dots(full: Column) -> Column:
    parts = F.split(full, "/", -1)
    kept = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc)
        .otherwise(F.array_append(acc, p)),
    )
    tail = F.when(full.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(kept, "/"), tail)
    rooted = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return rooted


def base_parts(base: Column) -> Column:
    """The parts of a base URL that references are resolved against."""
    return let(
        F.struct(scheme(base).alias("scheme"), netloc(base).alias("netloc")),
        lambda b: F.struct(
            base.alias("url"),
            b["scheme"].alias("scheme"),
            F.concat(b["scheme"], F.lit("://"), b["netloc"]).alias("site"),
            F.regexp_extract(base, _PATH, 1).alias("path"),
            F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
        ),
    )


def resolve(parts: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` for a base given by :func:`base_parts` (RFC 3986)."""
    cleaned = F.translate(F.ltrim(ref, F.lit("".join(map(chr, range(1, 0x21))))), "\t\r\n", "")

    def relative(r: Column) -> Column:
        path_part = F.regexp_extract(r, r"^([^?#]*)", 1)

        def build(ref_path: Column) -> Column:
            tail = F.substr(r, F.length(ref_path) + 1)
            return (
                F.when((ref_path == "") & tail.rlike(r"^\?[^#]"), F.concat(parts["site"], parts["path"], tail))
                # an empty query counts as none
                .when(ref_path == "", F.concat(parts["site"], parts["path"], parts["query"], F.regexp_replace(tail, r"^\?", "")))
                .otherwise(F.concat(parts["site"], _merge_path(parts["path"], ref_path), tail))
            )

        return let(path_part, build)

    def with_scheme(r: Column, ref_scheme: Column) -> Column:
        same = ref_scheme == parts["scheme"]
        rest = F.substr(r, F.length(ref_scheme) + 2)
        return (
            F.when(~same, r)
            .when(rest.startswith("//"), F.concat(ref_scheme, F.lit(":"), rest))
            # "http:rest" with the scheme of the base is a relative reference
            .otherwise(relative(rest))
        )

    def choose(r: Column) -> Column:
        return (
            F.when(r == "", parts["url"])
            .when(r.startswith("//"), F.concat(parts["scheme"], F.lit(":"), r))
            .when(r.startswith("/") & ~F.contains(r, F.lit("/.")), F.concat(parts["site"], r))
            .otherwise(let(scheme(r), lambda s: F.when(s == "", relative(r)).otherwise(with_scheme(r, s))))
        )

    return let(cleaned, choose)


def join(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` on a page at ``base``."""
    return let(base_parts(base), lambda parts: resolve(parts, ref))


def lower_scheme(url: Column) -> Column:
    lowered = let(
        F.regexp_extract(url, _SCHEME, 1), lambda s: F.concat(F.lower(s), F.substr(url, F.length(s) + 1))
    )
    return F.when(url.startswith("https://") | url.startswith("http://"), url).otherwise(lowered)


def percent_decode(text: Column) -> Column:
    """Decode %XX; a percent sign that starts no valid escape stays as it is."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(~F.contains(text, F.lit("%")), text).otherwise(F.coalesce(F.try_url_decode(safe), text))
