"""Structured data of a page: the JSON-LD scripts, read as variants inside the row.

A page may hold several scripts of type ``application/ld+json``.  Each is one object or
an array, and an object may keep its nodes in ``@graph``; all these are walked.
A script that is no JSON counts as broken and gives nothing, the others still do.
Scripts within comments, other scripts, templates or text areas are none.

What a page says about itself is taken from its nodes in this order: articles,
then pages, then the site or its publisher (fixed lists below); within a kind
the first node that has the property wins.  Where a value is a reference
(``{"@id": ..}``), the name of the node with that id is meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafpress.functions import html as H
from leafpress.functions.arrays import collapse_spaces, let

# Schema.org types whose properties describe the page.
ARTICLES = (
    "Article", "NewsArticle", "BlogPosting", "LiveBlogPosting", "SocialMediaPosting", "ScholarlyArticle", "TechArticle", "Report",
    "AdvertiserContentArticle", "SatiricalArticle", "AnalysisNewsArticle", "AskPublicNewsArticle", "BackgroundNewsArticle",
    "OpinionNewsArticle", "ReportageNewsArticle", "ReviewNewsArticle", "MedicalScholarlyArticle", "DiscussionForumPosting",
)
PAGES = ("WebPage", "AboutPage", "CheckoutPage", "CollectionPage", "ContactPage", "FAQPage", "ItemPage", "MedicalWebPage", "ProfilePage", "QAPage")
SITES = ("WebSite", "Organization", "NewsMediaOrganization", "Corporation")

#: An element whose inside is not markup; which of them opens first decides.
_OPAQUE = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|noscript)(?:[\s/](?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)?>.*?(?:</\1[^>]*>|\z)"
)
_OPENING = rf"(?is)^{H.tag_pattern('script')}"


def scripts(html: Column) -> Column:
    """Bodies of the JSON-LD scripts, in order."""
    opaque = F.regexp_extract_all(html, F.lit(_OPAQUE), F.lit(0))
    typed = F.filter(
        opaque,
        lambda e: e.rlike(r"(?i)^<script") & H.attribute(F.regexp_extract(e, _OPENING, 0), "type").rlike(r"(?i)^\s*application/ld\+json\s*(?:;|$)"),
    )

    def body(e: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(e, _OPENING, ""), r"(?is)</script[^>]*>\z", "")
        return F.regexp_replace(inside, r"(?s)\A\s*(?:<!--|//\s*<!\[CDATA\[|/\*\s*<!\[CDATA\[\s*\*/|<!\[CDATA\[)|(?:-->|//\s*\]\]>|/\*\s*\]\]>\s*\*/|\]\]>)\s*\z", "")

    return F.when(html.rlike(r"(?i)ld\+json"), F.transform(typed, body)).otherwise(F.array().cast("array<string>"))


def _at(node: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f"$['{key}']", kind)


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _many(v: Column) -> Column:
    """A variant as an array: its elements if it is one, else itself alone, empty for null."""
    listed = F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    return F.coalesce(listed, F.array().cast("array<variant>"))


def nodes(bodies: Column) -> Column:
    """All nodes of the scripts that can be read: their objects, and those of ``@graph``."""
    read = F.filter(F.transform(bodies, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    tops = F.filter(F.flatten(F.transform(read, _many)), _is_object)
    return F.flatten(F.transform(tops, lambda t: F.concat(F.array(t), F.filter(_many(_at(t, "@graph")), _is_object))))


def _placed(every: Column) -> Column:
    """Places of the nodes that are articles, pages or sites, in this order: kind (0 to 2), place, whether it is a site."""

    def place(n: Column, i: Column) -> Column:
        # types without the address of the vocabulary
        types = F.transform(_many(_at(n, "@type")), lambda t: F.regexp_extract(F.try_variant_get(t, "$", "string"), r"([^/#:]*)$", 1))
        among = F.transform(F.array(*[F.lit(",".join(k)) for k in (ARTICLES, PAGES, SITES)]), lambda k: F.exists(types, lambda t: F.find_in_set(t, k) > 0))
        return let(among, lambda m: F.struct((F.array_position(m, True) - 1).alias("kind"), i.alias("i"), F.get(m, 2).alias("site")))

    return F.sort_array(F.filter(F.transform(every, place), lambda p: p["kind"] >= 0))


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def _names(v: Column, every: Column) -> Column:
    """Names that a property gives: texts, objects with a name, references to nodes with one, or a list of these."""

    def name(x: Column) -> Column:
        referred = F.get(F.filter(every, lambda n: (_at(n, "@id", "string") == _at(x, "@id", "string")) & _at(n, "name").isNotNull()), F.lit(0))
        own = F.coalesce(_at(x, "name", "string"), _at(referred, "name", "string"))
        return _filled(F.when(_is_object(x), own).otherwise(F.try_variant_get(x, "$", "string")))

    return F.filter(F.transform(_many(v), name), lambda t: t.isNotNull())


def _known(every: Column) -> Column:
    """The articles, pages and sites: kind, site, names by property, name of the language's object."""
    properties = F.split(F.lit(" ".join(_PROPERTIES)), " ")

    def of(p: Column, n: Column) -> Column:
        said = F.transform(properties, lambda k: _names(F.try_variant_get(n, F.concat(F.lit("$['"), k, F.lit("']")), "variant"), every))
        spoken = _at(F.get(_many(_at(n, "inLanguage")), F.lit(0)), "alternateName", "string")
        return F.struct(p["kind"].alias("kind"), p["site"].alias("site"), said.alias("said"), spoken.alias("spoken"))

    return F.transform(_placed(every), lambda p: of(p, F.get(every, p["i"])))


# Properties that are read, and how a language is named within its object.
_PROPERTIES = (
    "headline", "name", "author", "creator", "datePublished", "dateCreated", "dateModified", "description", "publisher", "inLanguage",
    "articleSection", "keywords",
)


def structured(html: Column) -> Column:
    """Struct of ``scripts``, ``broken`` (counts), and what the nodes say: title, author (names joined by ``; ``), date,
    description, sitename, language (primary tag), categories and tags, NULL where nothing is said."""

    def first(said: Column, *keys: str) -> Column:
        """Names of the first of the properties that the first node with any of them has."""
        at = [_PROPERTIES.index(k) for k in keys]
        own = F.transform(said, lambda n: F.coalesce(*[F.when(F.size(F.get(n, i)) > 0, F.get(n, i)) for i in at]))
        return F.get(F.filter(own, lambda x: x.isNotNull()), F.lit(0))

    def told(known: Column) -> Column:
        about = F.filter(known, lambda n: n["kind"] < 2)

        def from_all(said: Column) -> Column:
            site = F.get(F.filter(F.transform(F.filter(known, lambda n: n["site"]), lambda n: F.get(n["said"], _PROPERTIES.index("name"))), lambda x: F.size(x) > 0), F.lit(0))
            spoken = F.get(F.filter(F.transform(about, lambda n: n["spoken"]), lambda x: x.isNotNull()), F.lit(0))
            raw = F.array(
                first(said, "headline", "name"), first(said, "author", "creator"), first(said, "datePublished", "dateCreated", "dateModified"),
                first(said, "description"), F.coalesce(first(said, "publisher"), site),
                F.coalesce(F.when(spoken.isNotNull(), F.array(spoken)), first(said, "inLanguage")), first(said, "articleSection"), first(said, "keywords"),
            )
            # one name alone, or the parts of lists with commas; character references are decoded once for all fields
            cut = F.transform(raw, lambda names, i: F.when(i.isin(0, 2, 3, 4), F.slice(names, 1, 1)).when(i > 5, F.flatten(F.transform(names, lambda t: F.split(t, r"\s*,\s*")))).otherwise(names))
            clean = F.transform(cut, lambda names: F.filter(F.transform(names, lambda t: collapse_spaces(H.decode_entities(t))), lambda t: t != ""))
            return let(clean, as_fields)

        return let(F.transform(about, lambda n: n["said"]), from_all)

    def as_fields(v: Column) -> Column:
        one = lambda i: F.get(F.get(v, i), F.lit(0))
        many = lambda i: F.when(F.size(F.get(v, i)) > 0, F.get(v, i))
        return F.struct(
            one(0).alias("title"), F.array_join(many(1), "; ").alias("author"), one(2).alias("date"), one(3).alias("description"), one(4).alias("sitename"),
            F.nullif(F.lower(F.regexp_extract(one(5), r"^\s*([A-Za-z]{2,3})(?:[-_]|\s*$)", 1)), F.lit("")).alias("language"),
            many(6).alias("categories"), many(7).alias("tags"),
        )

    def read(bodies: Column) -> Column:
        broken = F.size(F.filter(bodies, lambda b: F.try_parse_json(b).isNull()))
        return F.when(
            F.size(bodies) > 0,
            let(let(let(nodes(bodies), _known), told), lambda t: F.struct(F.size(bodies).alias("scripts"), broken.alias("broken"), *[t[f].alias(f) for f in FIELDS])),
        )

    return let(scripts(html), read)


FIELDS = ("title", "author", "date", "description", "sitename", "language", "categories", "tags")
