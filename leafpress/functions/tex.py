"""Math notation in text: detection, extraction and cleaning of TeX."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions import html as H
from leafpress.functions.arrays import let, strip

# Signs that a page holds math; upper and lower case alike.
MATH_SIGNS = (
    r'class="katex"',
    r"katex\.min\.(?:css|js)",
    r"mathjax",
    r"script.*math/tex",
    r'type="math/tex"',
    r"<math[>\s]",
    r'xmlns="http://www\.w3\.org/1998/Math/MathML"',
    r'class="mwe-math',
    r"\$\$.*\$\$",
    r"\\\(.*\\\)",
    r"\\\[.*\\\]",
    r"\\begin\{equation",
    r"\\frac\{",
    r"\\sqrt\{",
    r"\\sum_",
    r"\\int_",
)

# Delimiters of math in text, display forms before inline ones.
DISPLAY_FORMS = (
    r"\$\$([^$]+)\$\$",
    r"\\\[([^\]]+)\\\]",
    r"(?s)\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}",
    r"(?s)\\begin\{align\*?\}(.*?)\\end\{align\*?\}",
)
INLINE_FORMS = (r"\$([^$\n]+)\$", r"\\\(([^)]+)\\\)")

TEX_SCRIPT = r"""(?is)<script(?=\s)(?=[^>]*\stype\s*=\s*["']?math/tex)[^>]*>.*?</script\s*>"""
TEX_ANNOTATION = r"""(?is)<annotation(?=\s)[^>]*encoding\s*=\s*["']?application/x-tex["']?[^>]*>(.*?)</annotation"""


def has_math(html: Column) -> Column:
    """Whether a page likely holds math; linear in the length of the page.

    A sign of two marks holds if the second stands anywhere after the first place of
    the first, so neither is looked for again from each place of the other.
    """
    test = html.rlike("(?is)" + "|".join(s for s in MATH_SIGNS if ".*" not in s))
    for first, second in (s.split(".*") for s in MATH_SIGNS if ".*" in s):
        at = F.regexp_instr(html, F.lit("(?i)" + first))
        after = at + len(re.sub(r"\\(.)", r"\1", first))
        test = test | ((at > 0) & F.substr(html, after).rlike("(?i)" + second))
    return test


def first_math(text: Column) -> Column:
    """First math in a text as ``$$x$$`` or ``$x$``: display forms first, NULL if none."""

    def find(t: Column) -> Column:
        def group(form: str, mark: str) -> Column:
            inner = let(strip(F.regexp_extract(t, form, 1)), lambda x: F.nullif(x, F.lit("")))
            return F.concat(F.lit(mark), inner, F.lit(mark))

        return F.coalesce(*[group(f, "$$") for f in DISPLAY_FORMS], *[group(f, "$") for f in INLINE_FORMS])

    return let(F.regexp_replace(strip(text), r"(?U)\s+", " "), find)


def clean_tex(tex: Column) -> Column:
    """Trim and take off an equation or align wrapper."""
    out = strip(tex)
    for env in ("equation", "align"):
        out = F.regexp_replace(out, rf"^\s*\\begin\{{{env}\*?\}}", "")
        out = F.regexp_replace(out, rf"\\end\{{{env}\*?\}}\s*$", "")
    return strip(out)


def wrap_tex(tex: Column, display: Column) -> Column:
    return F.when(display, F.concat(F.lit("\n$$"), tex, F.lit("$$\n"))).otherwise(F.concat(F.lit("$"), tex, F.lit("$")))


def annotation_tex(html: Column) -> Column:
    """All TeX annotations of MathML in a page, cleaned, blank ones left out."""
    raw = F.regexp_extract_all(html, F.lit(TEX_ANNOTATION), F.lit(1))
    return F.filter(F.transform(raw, lambda t: clean_tex(H.decode_entities(t))), lambda t: t != "")


def script_tex(html: Column) -> Column:
    """All ``math/tex`` scripts: array of (tex, display)."""
    scripts = F.transform(
        F.regexp_extract_all(html, F.lit(TEX_SCRIPT), F.lit(0)),
        lambda s: F.struct(
            clean_tex(F.regexp_replace(s, r"(?is)^<script[^>]*>|</script\s*>$", "")).alias("tex"),
            F.regexp_extract(s, "(?is)^<[^>]*>", 0).contains("mode=display").alias("display"),
        ),
    )
    return F.filter(scripts, lambda s: s["tex"] != "")


DELIMITED = r"(?s)\$\$([^$]+)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\$([^$\n]+)\$"


def delimited_tex(text: Column) -> Column:
    """All TeX between delimiters in a text: array of (tex, display)."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(DELIMITED), F.lit(0)),
        lambda m: F.struct(
            clean_tex(F.when(m.startswith("$") & ~m.startswith("$$"), F.substr(m, F.lit(2), F.length(m) - 2)).otherwise(F.substr(m, F.lit(3), F.length(m) - 4))).alias("tex"),
            (m.startswith("$$") | m.startswith("\\[")).alias("display"),
        ),
    )
    return F.filter(found, lambda m: m["tex"] != "")


def math_counts(content: Column) -> Column:
    """Inline, display and total math; the inside of display math counts as inline too."""
    inline = F.regexp_count(content, F.lit(r"\$[^$\n]+\$"))
    display = F.regexp_count(content, F.lit(r"(?s)\$\$[^$]+\$\$"))
    return F.struct(inline.alias("inline_math"), display.alias("display_math"), (inline + display).alias("total_expressions"))
