"""Math in stored pages normalised to TeX between dollar signs.

Works inside the page's row: rendered KaTeX and MediaWiki elements are found with
one fold over the tags, MathML with a TeX annotation and ``math/tex`` scripts by
pattern.  Only MathML without TeX goes through Python, as Arrow batches of just
those elements.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from leafpress.functions import html as H
from leafpress.functions import tex as X
from leafpress.functions.arrays import built_once, free_names, let, replace_each, scan, with_computed
from leafpress.functions.mathml import mathml_to_tex
from leafpress.session import ship_package

_OPAQUE = r"<!--.*?(?:-->|\z)|<script(?:\s[^>]*)?>.*?(?:</script[^>]*>|\z)|<style(?:\s[^>]*)?>.*?(?:</style[^>]*>|\z)"
_PIECES = rf"(?is){_OPAQUE}|<[A-Za-z/!?][^>]*>|[^<]+|<"
_MATH = r"<math(?:\s[^>]*)?>.*?</math\s*>"
_MATH_OR_OPAQUE = rf"(?is){_OPAQUE}|{_MATH}"
_RENDERED = r"(?i)class\s*=\s*[\"'][^\"']*(?:katex|mwe-math-element)"

_ID_STEP = 4  # region numbers start above two flag bits


def _class_words(tag: Column) -> Column:
    return F.split(F.lower(F.coalesce(H.attribute(tag, "class"), F.lit(""))), r"\s+")


def _event(token: Column) -> Column:
    """Name, direction and math classes of a tag; NULL for text and opaque parts."""
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    is_tag = token.rlike(r"^</?[A-Za-z]") & ~token.rlike(r"(?is)^<(?:script|style)[\s>]|/>$")

    def build(words: Column) -> Column:
        def has(word: str) -> Column:
            return F.array_contains(words, word)

        return F.struct(
            name.alias("name"),
            F.when(token.startswith("</"), -1).otherwise(1).alias("dir"),
            (has("katex") | has("mwe-math-element")).alias("root"),
            has("katex-display").alias("shown"),
        )

    none = F.array().cast("array<string>")
    return F.when(is_tag, let(F.when(token.rlike(_RENDERED), _class_words(token)).otherwise(none), build))


def _follow(tag: Column, depth: Column, event: Column, starts: Column) -> Column:
    change = F.when(event["name"] == tag, event["dir"]).otherwise(0)
    opened = F.struct(event["name"].alias("tag"), F.lit(1).alias("depth"))
    going = F.struct(tag.alias("tag"), (depth + change).alias("depth"))
    still = F.struct(tag.alias("tag"), depth.alias("depth"))
    return F.when(depth > 0, going).when(starts, opened).otherwise(still)


def _step(state: Column, event: Column) -> Column:
    opens = event["dir"] == 1
    starts = opens & event["root"] & (state["root"]["depth"] == 0)
    moved = F.struct(
        _follow(state["root"]["tag"], state["root"]["depth"], event, starts).alias("root"),
        _follow(state["shown"]["tag"], state["shown"]["depth"], event, opens & event["shown"]).alias("shown"),
        F.when(starts, state["n"] + 1).otherwise(state["n"]).alias("n"),
        (state["root"]["depth"] > 0).alias("was_in"),
    )
    stays = F.struct(
        state["root"].alias("root"), state["shown"].alias("shown"), state["n"].alias("n"),
        (state["root"]["depth"] > 0).alias("was_in"),
    )
    return F.when(event.isNull(), stays).otherwise(moved)


def _emit(state: Column) -> Column:
    """Region number and display bit; 0 outside.  The closing tag still belongs."""
    inside = (state["root"]["depth"] > 0) | state["was_in"]
    return F.when(
        inside, state["n"].cast("bigint") * _ID_STEP + F.when(state["shown"]["depth"] > 0, 1).otherwise(0)
    ).otherwise(F.lit(0).cast("bigint"))


def _converted(tex: Column, display: Column) -> Column:
    """The element that takes the place of a piece of math."""
    safe = F.replace(F.replace(F.replace(tex, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(display, F.lit("div")).otherwise(F.lit("span"))
    return F.concat(
        F.lit("<"), tag, F.lit(' class="math-converted" data-math="true">'), X.wrap_tex(safe, display), F.lit("</"), tag, F.lit(">")
    )


def _annotated(fragment: Column) -> Column:
    """First TeX annotation of a fragment that is not blank, NULL if there is none."""
    return F.get(X.annotation_tex(fragment), F.lit(0))


def _replace_rendered(html: Column) -> Column:
    """Swap KaTeX and MediaWiki elements for their TeX: struct (html, n)."""
    zero = F.expr(
        "named_struct('root', named_struct('tag', '', 'depth', 0), 'shown', named_struct('tag', '', 'depth', 0), 'n', 0, 'was_in', false)"
    )

    def work(parts: Column) -> Column:
        return let(scan(F.transform(parts, _event), zero, _step, _emit), lambda ids: splice(parts, ids))

    def splice(parts: Column, ids: Column) -> Column:
        def region(i: Column) -> Column:
            return F.floor(F.coalesce(F.get(ids, i), F.lit(0)) / _ID_STEP)

        at = F.transform(ids, lambda v, i: i)
        begins = F.filter(at, lambda i: (region(i) > 0) & ((i == 0) | (region(i) != region(i - 1))))
        ends = F.filter(at, lambda i: (region(i) > 0) & (region(i) != region(i + 1)))
        spans = F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e")))
        return let(spans, lambda s: rebuild(parts, ids, s))

    def rebuild(parts: Column, ids: Column, spans: Column) -> Column:
        def text(begin: Column, end: Column) -> Column:
            return F.array_join(F.slice(parts, begin + 1, F.greatest(end - begin, F.lit(0))), "")

        def one(s: Column, j: Column) -> Column:
            before = F.when(j == 0, F.lit(0)).otherwise(F.get(spans, j - 1)["e"] + 1)
            return let(text(s["b"], s["e"] + 1), lambda own: swap(s, text(before, s["b"]), own))

        def swap(s: Column, before: Column, own: Column) -> Column:
            root = F.get(parts, s["b"])
            katex = F.array_contains(_class_words(root), "katex")
            tex = F.when(katex & ~own.rlike(r"(?i)katex-mathml"), F.lit(None)).otherwise(_annotated(own))
            block = F.array_contains(_class_words(root), "mwe-math-element-block")
            shown = F.get(ids, s["b"]).bitwiseAND(F.lit(1).cast("bigint")) == 1
            display = F.when(katex, shown).otherwise(block)
            return let(tex, lambda t: F.struct(
                F.concat(before, F.when(t.isNull(), own).otherwise(_converted(t, display))).alias("h"),
                F.when(t.isNull(), 0).otherwise(1).alias("n"),
            ))

        last = F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.get(spans, F.size(spans) - 1)["e"] + 1)
        return let(
            F.transform(spans, one),
            lambda done: F.struct(
                F.concat(F.array_join(F.transform(done, lambda d: d["h"]), ""), text(last, F.size(parts))).alias("html"),
                F.aggregate(done, F.lit(0), lambda a, d: a + d["n"]).alias("n"),
            ),
        )

    pieces = F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0))
    untouched = F.struct(html.alias("html"), F.lit(0).alias("n"))
    return F.when(html.rlike(_RENDERED), let(pieces, work)).otherwise(untouched)


@built_once
def _rendered_replaced(html: str) -> Column:
    return _replace_rendered(F.col(html))


def _is_block(fragment: Column) -> Column:
    opening = F.regexp_extract(fragment, r"(?is)^<math(?:\s[^>]*)?>", 0)
    return F.lower(F.coalesce(H.attribute(opening, "display"), F.lit(""))) == "block"


def _replace_annotated(hit: Column) -> Column:
    tex = F.when(hit.rlike("(?i)^<math"), _annotated(hit))
    return let(tex, lambda t: F.when(t.isNull(), hit).otherwise(_converted(t, _is_block(hit))))


def _replace_script(hit: Column) -> Column:
    found = F.get(X.script_tex(hit), F.lit(0))
    return let(found, lambda s: F.when(s.isNull(), hit).otherwise(_converted(s["tex"], s["display"])))


@pandas_udf(ArrayType(StructType([StructField("tex", StringType()), StructField("error", StringType())])))
def _fragments_to_tex(fragments: pd.Series) -> pd.Series:
    """TeX of MathML elements, or what went wrong: an odd element leaves the page's others alone."""

    def safe(fragment):
        try:
            return {"tex": mathml_to_tex(fragment), "error": None}
        except Exception as e:
            return {"tex": None, "error": f"math: {type(e).__name__}: {e}"}

    return fragments.map(lambda fs: None if fs is None else [safe(f) for f in fs])


def _count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


_CONVERTED_MARK = '<(?:span|div) class="math-converted"'
_MATH_TAG = r"(?i)<math[\s>]"
_KATEX_TAG = r"""(?i)<[a-z][^>]*\sclass\s*=\s*["'](?:[^"']*\s)?katex(?:\s[^"']*)?["']"""
_MATHJAX_TAG = r"""(?i)<mjx-container[\s>]|<[a-z][^>]*\sclass\s*=\s*["'](?:[^"']*\s)?MathJax(?:\s[^"']*)?["']"""


def normalize_math(pages: DataFrame, fallback: bool = True, error: str | None = None) -> DataFrame:
    """Replace math in ``html`` by TeX and add ``math``, the counts of the page.

    Order: KaTeX and MediaWiki elements, annotated MathML, math/tex scripts, then
    (with ``fallback``) MathML that is left.  ``math`` holds processed,
    remaining_math, remaining_katex, remaining_mathjax (all before the fallback)
    and fallback_processed.  With ``error``, a column of that name has the first error
    of the fallback on a page; the element that caused it stays as it is.
    """
    r, h, left, tex = free_names(pages, "_r", "_h", "_left", "_tex")
    own = F.col(h)
    step = with_computed(pages, r, _rendered_replaced("html")).withColumn(h, F.col(f"{r}.html"))
    has_more = own.rlike(r"(?i)<math[\s>]|math/tex")
    step = step.withColumn(
        h,
        F.when(
            has_more,
            replace_each(replace_each(own, _MATH_OR_OPAQUE, _replace_annotated), X.TEX_SCRIPT, _replace_script),
        ).otherwise(own),
    )
    marks = _count(own, _CONVERTED_MARK) - _count(F.col("html"), _CONVERTED_MARK)
    step = step.withColumn(
        "math",
        F.when(
            own.isNotNull(),
            let(
                H.strip_hidden(own),
                lambda v: F.struct(
                    marks.alias("processed"),
                    _count(v, _MATH_TAG).alias("remaining_math"),
                    _count(v, _KATEX_TAG).alias("remaining_katex"),
                    _count(v, _MATHJAX_TAG).alias("remaining_mathjax"),
                ),
            ),
        ),
    )
    failed = F.lit(None).cast("string")
    if fallback:
        ship_package(pages.sparkSession)
        found = F.transform(
            F.regexp_extract_all(h, F.lit(_MATH_OR_OPAQUE), F.lit(0)), lambda x: F.when(x.rlike("(?i)^<math"), x)
        )
        wanted = F.when(F.col("math.remaining_math") > 0, found)
        step = step.withColumn(left, wanted).withColumn(tex, _fragments_to_tex(left))
        hits = F.regexp_extract_all(h, F.lit(_MATH_OR_OPAQUE), F.lit(0))
        swapped = F.zip_with(
            hits,
            F.col(tex),
            lambda x, t: F.when(t["tex"].isNull(), x).otherwise(_converted(t["tex"], _is_block(x))),
        )
        rebuilt = F.array_join(
            F.zip_with(F.split(h, _MATH_OR_OPAQUE, -1), swapped, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), ""
        )
        step = step.withColumn(h, F.when(F.col(tex).isNull(), own).otherwise(rebuilt))
        extra = F.when(F.col(tex).isNull(), 0).otherwise(F.size(F.filter(tex, lambda t: t["tex"].isNotNull())))
        failed = F.get(F.filter(F.transform(tex, lambda t: t["error"]), lambda e: e.isNotNull()), F.lit(0))
    else:
        extra = F.lit(0)
    math = F.when(F.col("math").isNotNull(), F.col("math").withField("fallback_processed", extra))
    step = step.withColumn("math", math).withColumn("html", own)
    return (step.withColumn(error, failed) if error else step).drop(r, h, left, tex)


def math_totals(normalized: DataFrame) -> DataFrame:
    """Counts over all pages, one row."""
    names = ("processed", "remaining_math", "remaining_katex", "remaining_mathjax", "fallback_processed")
    return normalized.agg(
        F.count_if(F.col("math.processed") + F.col("math.fallback_processed") > 0).alias("pages_with_math"),
        *[F.sum(f"math.{n}").alias(n) for n in names],
    )
