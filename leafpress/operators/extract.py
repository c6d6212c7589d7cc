"""Main-content extraction, done inside each page's row.

A page is cut at its block tags, container flags are carried along the pieces
with a running fold, and boilerplate is dropped by container and link density.
Nothing here needs a shuffle: the job is one scan, one projection, one write.

Keep rule (ours):

* recall (default): a block is kept if it has text, lies outside nav, footer,
  aside, form, an outer header and any ad-like element, and less than half of
  its characters are link text;
* precision: in addition it lies in article or main if the page has one, and is
  a heading or has at least 25 characters;
* context: as precision, but a page's blocks are decided together.  Keeping a block gains
  its characters (100 at most) less 25, a heading gains 10, a block that may not be kept never is;
  each change from kept to dropped or back along the page costs 15.  The choice with the
  greatest sum is taken, with ties for keeping: a short line between kept blocks stays,
  two of them in a row or one among dropped blocks do not.

An element is ad-like if its class or id holds one of the words ad, ads, advert,
promo, cookie, share or sponsor; a comment section if it holds comment(s).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import html as H
from leafpress.functions.arrays import built_once, collapse_spaces, first_by, free_names, let, replace_each, scan, with_computed
from leafpress.functions.names import format_name
from leafpress.operators.language import by_ngrams, primary_tag, told_language
from leafpress.operators.metadata import metadata_of
from leafpress.session import ship_package

MIN_PRECISE_CHARS = 25
MAX_LINK_SHARE = 0.5
FULL_CHARS = 100
HEADING_GAIN = 10
CHANGE_COST = 15
_NEVER = -1_000_000

_CONTAINERS = ("nav", "footer", "aside", "form", "header", "article", "table", "blockquote")
_FLAGGABLE = "div|section|aside|ul|ol|article|figure"
_STATEFUL = [s + t for t in (*_CONTAINERS, "main", *_FLAGGABLE.split("|")) for s in ("", "/")]
_FLAG_WORDS = (r"(?:ad|ads|advert|promo|cookie|share|sponsor)", r"comments?")
# Bits of the integer that a block carries: the containers, then these.
_BIT = {name: 1 << i for i, name in enumerate((*_CONTAINERS, "ad", "comments", "link"))}
_LINK = H.tag_pattern("a")


def _flags(tag: Column) -> Column:
    """Whether an opening tag's class or id marks it as an ad or as comments."""

    def test(marks: Column) -> Column:
        return F.array(*[marks.rlike(rf"(?i)(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)") for w in _FLAG_WORDS])

    both = let(H.attributes(tag), lambda a: F.concat_ws(" ", H.pick(a, "class"), H.pick(a, "id")))
    # most tags have no class or id: do not read attributes for them
    return F.when(tag.rlike("(?i)(?:class|id)[ =]"), let(both, test))


def _event(piece: Column) -> Column:
    """What a piece's leading tag and anchors do to the state; NULL for nothing."""
    seg, lead = piece["seg"], piece["lead"]
    base = F.regexp_replace(lead, "^/", "")
    slot = F.array_position(F.array(*map(F.lit, _CONTAINERS)), F.when(base == "main", F.lit("article")).otherwise(base))
    has_link = seg.rlike(r"(?i)<(?:a\s|/a)")
    event = F.struct(
        lead.alias("name"),
        slot.alias("slot"),
        F.when(lead.startswith("/"), F.lit(-1)).otherwise(F.lit(1)).alias("delta"),
        _flags(F.regexp_extract(seg, "(?i)^" + H.tag_pattern(_FLAGGABLE), 0)).alias("flags"),
        F.when(has_link, F.lower(F.regexp_extract(seg, r"(?is)^.*(<a\s|</a)", 1))).alias("last_link"),
    )
    return F.when(lead.isin(*_STATEFUL) | has_link, event)


def _follow(region: Column, flag: Column, name: Column) -> Column:
    """Depth inside one flagged element, 0 once it is closed."""
    inside = region["depth"] > 0
    change = F.when(name == region["tag"], 1).when(name == F.concat(F.lit("/"), region["tag"]), -1).otherwise(0)
    return (
        F.when(inside, F.struct(region["tag"].alias("tag"), (region["depth"] + change).alias("depth")))
        .when(flag, F.struct(name.alias("tag"), F.lit(1).alias("depth")))
        .otherwise(region)
    )


def _step(state: Column, event: Column) -> Column:
    depth = F.when(event["slot"] == 0, state["depth"]).otherwise(
        F.transform(
            state["depth"],
            lambda d, i: F.when(i + 1 == event["slot"], F.greatest(d + event["delta"], F.lit(0))).otherwise(d),
        )
    )
    quiet = event["flags"].isNull() & ~F.exists(state["regions"], lambda r: r["depth"] > 0)
    regions = F.when(quiet, state["regions"]).otherwise(
        F.transform(
            state["regions"],
            lambda r, i: _follow(r, F.coalesce(F.get(event["flags"], i), F.lit(False)), event["name"]),
        )
    )
    in_link = F.when(event["last_link"].isNull(), state["in_link"]).otherwise(event["last_link"] != "</a")
    changed = F.struct(depth.alias("depth"), regions.alias("regions"), in_link.alias("in_link"))
    return F.when(event.isNull(), state).otherwise(changed)


def _bits(state: Column) -> Column:
    """Where a piece lies, as one integer."""
    containers = F.aggregate(
        state["depth"], F.lit(0), lambda acc, d: F.shiftright(acc, 1) + F.when(d > 0, 1 << (len(_CONTAINERS) - 1)).otherwise(0)
    )
    extra = [(F.get(state["regions"], i)["depth"] > 0, b) for i, b in enumerate(("ad", "comments"))]
    extra.append((state["in_link"], "link"))
    out = containers
    for condition, name in extra:
        out = out + F.when(condition, _BIT[name]).otherwise(0)
    return out


def _has(bits: Column, name: str) -> Column:
    return bits.bitwiseAND(F.lit(_BIT[name])) != 0


def _zero() -> Column:
    return F.expr(
        f"named_struct('depth', array_repeat(0, {len(_CONTAINERS)}),"
        f" 'regions', array_repeat(named_struct('tag', '', 'depth', 0), {len(_FLAG_WORDS)}), 'in_link', false)"
    )


def _plain(fragment: Column) -> Column:
    return collapse_spaces(H.decode_entities(H.strip_tags(fragment)))


def _marked(fragment: Column, links: bool, images: bool, formatting: bool) -> Column:
    """Inline Markdown of a segment, before the other tags are stripped."""
    out = fragment
    if images:
        out = replace_each(
            out,
            "(?i)" + H.tag_pattern("img"),
            lambda t: let(
                H.attributes(t),
                lambda a: F.concat(
                    F.lit("!["), F.coalesce(H.pick(a, "alt"), F.lit("")),
                    F.lit("]("), F.coalesce(H.pick(a, "src"), F.lit("")), F.lit(")"),
                ),
            ),
        )
    if formatting:
        for names, mark in (("b|strong", "**"), ("i|em", "*"), ("code|kbd|samp", "`"), ("del|strike", "~~")):
            out = F.regexp_replace(
                out, rf"(?is){H.tag_pattern(names)}\s*([^<\s](?:[^<]*[^<\s])?)\s*</(?:{names})\s*>", f"{mark}$1{mark}"
            )
    if links:
        out = replace_each(
            out,
            rf"(?is){_LINK}.*?</a\s*>",
            lambda t: let(
                H.attribute(F.regexp_extract(t, "(?is)^" + _LINK, 0), "href"),
                lambda h: F.coalesce(F.concat(F.lit("["), F.trim(H.strip_tags(t)), F.lit("]("), h, F.lit(")")), t),
            ),
        )
    return _plain(out)


def blocks(html: Column, links: bool = False, images: bool = False, formatting: bool = False) -> Column:
    """Array of a page's text blocks with their flags, empty blocks left out."""
    is_marked = links or images or formatting
    segments = H.block_segments(H.strip_unseen(html))

    def build(segs: Column) -> Column:
        pieces = F.transform(
            segs,
            lambda s: F.struct(s.alias("seg"), F.lower(F.regexp_extract(s, r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1)).alias("lead")),
        )
        return let(pieces, lambda ps: let(scan(F.transform(ps, _event), _zero(), _step, _bits), lambda st: join(ps, st)))

    def join(pieces: Column, states: Column) -> Column:
        # the state before a piece says whether a link is still open
        paired = F.transform(
            pieces,
            lambda p, i: F.struct(
                p["seg"].alias("seg"),
                p["lead"].alias("lead"),
                F.get(states, i).alias("bits"),
                _has(F.coalesce(F.get(states, i - 1), F.lit(0)), "link").alias("carry"),
            ),
        )
        return F.filter(F.transform(paired, one), lambda b: b["marked"] != "")

    def one(p: Column) -> Column:
        seg = p["seg"]
        has_link = p["carry"] | seg.rlike(r"(?i)<a\s")
        linked = F.when(p["carry"], F.concat(F.lit('<a href="">'), seg)).otherwise(seg)
        unlinked = F.regexp_replace(linked, rf"(?is)<a(?=\s)(?=[^>]*href){H._INSIDE}>.*?(?:</a\s*>|\z)", "")
        variants = [seg, F.when(has_link, unlinked)]
        if is_marked:
            variants.append(_marked(seg, links, images, formatting))
        return let(F.transform(F.array(*variants), _plain), lambda v: fields(p, v))

    def fields(p: Column, v: Column) -> Column:
        text, marked = F.get(v, 0), F.get(v, 2 if is_marked else 0)
        kind, row = p["lead"], p["lead"] == "tr"
        within = {name: _has(p["bits"], name) for name in _BIT}
        return F.struct(
            F.when(kind.rlike("^(?:h[1-6]|li|tr|pre)$"), kind)
            .when(within["blockquote"], F.lit("blockquote"))
            .otherwise(F.lit("p"))
            .alias("kind"),
            text.alias("text"),
            F.when(row, F.regexp_replace(marked, r"^\| ", "")).otherwise(marked).alias("marked"),
            F.length(text).alias("chars"),
            (F.length(text) - F.length(F.coalesce(F.get(v, 1), text))).alias("link_chars"),
            within["nav"].alias("in_nav"),
            within["footer"].alias("in_footer"),
            within["aside"].alias("in_aside"),
            within["form"].alias("in_form"),
            (within["header"] & ~within["article"]).alias("in_header"),
            within["article"].alias("in_article"),
            within["table"].alias("in_table"),
            within["ad"].alias("in_ad"),
            within["comments"].alias("in_comments"),
        )

    return let(segments, build)


def is_content(block: Column) -> Column:
    """The recall rule for one block."""
    outside = ~(block["in_nav"] | block["in_footer"] | block["in_aside"] | block["in_form"] | block["in_header"] | block["in_ad"])
    return outside & (block["link_chars"] < block["chars"] * MAX_LINK_SHARE)


def _best_choice(found: Column, allowed: Callable[[Column], Column]) -> Column:
    """The blocks of the choice with the greatest sum of gains less changes (two states, forward and back over the page).

    Forward, each block leaves three bits: whether the best way to keep it comes from a kept one (1),
    whether the best way to drop it does (2), and whether keeping it is the better end (4).
    """
    has_article = F.exists(found, lambda b: b["in_article"])

    def gain(b: Column) -> Column:
        own = F.when(b["kind"].rlike("^h[1-6]$"), HEADING_GAIN).otherwise(F.least(b["chars"], F.lit(FULL_CHARS)) - MIN_PRECISE_CHARS)
        return F.when(allowed(b) & (b["in_article"] | ~has_article), own).otherwise(_NEVER).cast("bigint")

    def forward(s: Column, g: Column) -> Column:
        stay, leave = s["keep"] >= s["drop"] - CHANGE_COST, s["keep"] - CHANGE_COST >= s["drop"]
        keep = F.greatest(s["keep"], s["drop"] - CHANGE_COST) + g
        drop = F.greatest(s["drop"], s["keep"] - CHANGE_COST)
        bits = F.when(stay, 1).otherwise(0) + F.when(leave, 2).otherwise(0) + F.when(keep >= drop, 4).otherwise(0)
        return F.struct(keep.alias("keep"), drop.alias("drop"), bits.cast("bigint").alias("bits"))

    def back(s: Column, bits: Column) -> Column:
        def has(bit: int) -> Column:
            return bits.bitwiseAND(F.lit(bit).cast("bigint")) != 0

        return let(F.coalesce(s["before"], has(4)), lambda kept: F.struct(kept.alias("kept"), F.when(kept, has(1)).otherwise(has(2)).alias("before")))

    ways = scan(F.transform(found, gain), F.expr("named_struct('keep', 0L, 'drop', 0L, 'bits', 0L)"), forward, lambda s: s["bits"])
    start = F.expr("named_struct('kept', false, 'before', cast(null as boolean))")
    marks = F.reverse(scan(F.reverse(ways), start, back, lambda s: s["kept"].cast("int")))
    return let(marks, lambda m: F.filter(found, lambda b, i: F.get(m, i) == 1))


def keep_blocks(
    found: Column,
    include_tables: bool = True,
    include_comments: bool = False,
    include_images: bool = False,
    deduplicate: bool = True,
    favor_precision: bool = False,
    keep_context: bool = False,
) -> Column:
    """The blocks that make up the main content, in page order."""

    def rule(b: Column) -> Column:
        image_only = (b["chars"] == 0) if include_images else F.lit(False)
        ok = is_content(b) | (image_only & ~b["in_nav"] & ~b["in_footer"] & ~b["in_ad"])
        if not include_tables:
            ok = ok & ~b["in_table"]
        if not include_comments:
            ok = ok & ~b["in_comments"]
        return ok

    def choose(bs: Column) -> Column:
        if keep_context:
            return _best_choice(bs, rule)
        kept = F.filter(bs, rule)
        if not favor_precision:
            return kept
        has_article = F.exists(bs, lambda b: b["in_article"])
        return F.filter(
            kept,
            lambda b: (b["in_article"] | ~has_article) & (b["kind"].rlike("^h[1-6]$") | (b["chars"] >= MIN_PRECISE_CHARS)),
        )

    kept = let(found, choose)
    return first_by(kept, lambda b: F.lower(b["text"])) if deduplicate else kept


@built_once
def all_blocks(html: str, links: bool = False, images: bool = False, formatting: bool = False) -> Column:
    return blocks(F.col(html), links, images, formatting)


def _prefix(kind: Column) -> Column:
    level = F.substr(kind, F.lit(2), F.lit(1)).try_cast("int")
    return (
        F.when(kind.rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), level), F.lit(" ")))
        .when(kind == "li", F.lit("- "))
        .when(kind == "blockquote", F.lit("> "))
        .when(kind == "tr", F.lit("| "))
        .otherwise(F.lit(""))
    )


def markdown(kept: Column) -> Column:
    """Markdown of the kept blocks, a blank line between them."""
    return F.array_join(
        F.transform(
            kept,
            lambda b: F.concat(_prefix(b["kind"]), b["marked"], F.when(b["kind"] == "tr", F.lit(" |")).otherwise(F.lit(""))),
        ),
        "\n\n",
    )


def plain_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda b: b["marked"]), "\n")


@built_once
def page_body(
    html: str, markup: bool, links: bool, images: bool, formatting: bool, tables: bool, comments: bool, deduplicate: bool, precise: bool,
    context: bool,
) -> Column:
    """Text of the kept blocks of the page in column ``html``."""
    found = blocks(F.col(html), links, images, formatting)
    kept = keep_blocks(found, tables, comments, images, deduplicate, precise, context)
    return let(kept, markdown if markup else plain_text)


def token_table(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, token)``: the markup stream of every page."""
    return pages.filter(F.col("html").isNotNull()).select(
        "page_id", F.posexplode(H.tokens(H.strip_unseen(F.col("html")))).alias("pos", "token")
    )


def block_table(pages: DataFrame, links: bool = False, images: bool = False, formatting: bool = False) -> DataFrame:
    """One row per text block with its kind, flags and character counts."""
    return (
        pages.filter(F.col("html").isNotNull())
        .select("page_id", F.posexplode(all_blocks("html", links, images, formatting)).alias("block_no", "b"))
        .select("page_id", "block_no", "b.*")
    )


def extract_pages(
    pages: DataFrame,
    output_format: str = "markdown",
    include_comments: bool = False,
    include_tables: bool = True,
    include_links: bool = False,
    include_images: bool = False,
    include_formatting: bool = False,
    process_math: bool = False,
    deduplicate: bool = True,
    target_lang: str | None = None,
    with_metadata: bool = True,
    extract_images: bool = False,
    favor_precision: bool = False,
    keep_context: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """Clean content and metadata of every page.

    ``pages`` has ``html`` and any of ``page_id``, ``url``, ``file`` and further
    columns, which are passed through.  A page that gives nothing is kept with a
    status (no_page, empty, lang_mismatch, error); :func:`drop_failed` removes those.
    ``keep_context`` decides a page's blocks together (above) and takes the place of ``favor_precision``.
    ``max_chars`` bounds the work on one page: a longer page is not read, has the status
    error, and ``error`` says why.  ``error`` is also set where the math step raised on an element;
    that element stays as it was, and the rest of the page is extracted.
    Row-local throughout: partitions are worked on independently.
    """
    fmt = format_name(output_format)
    include_images = include_images or extract_images
    body, long, known, lang, failed, meta = free_names(pages, "_body", "_long", "_known", "_lang", "_math_error", "_meta")
    source = pages
    if max_chars is not None:
        source = pages.withColumn(long, F.coalesce(F.length("html") > max_chars, F.lit(False)))
        source = source.withColumn("html", F.when(~F.col(long), F.col("html")))
    if process_math:
        from leafpress.operators.math import normalize_math

        source = normalize_math(source, error=failed)
    html = F.col("html")
    out = with_computed(
        source,
        body,
        page_body(
            "html", fmt == "markdown", include_links, include_images, include_formatting,
            include_tables, include_comments, deduplicate, favor_precision, keep_context,
        ),
    )
    if extract_images and fmt == "markdown":
        from leafpress.operators.images import page_images

        out = out.withColumn("images", page_images("html", "url"))
    if target_lang:
        ship_package(pages.sparkSession)
        out = with_computed(out, known, told_language(html, F.col(body)))
        out = out.withColumn(lang, F.coalesce(F.col(known), by_ngrams(F.when(F.col(known).isNull(), F.col(body)))))
    too_long = F.when(F.col(long), F.lit(f"page of more than {max_chars} characters")) if max_chars is not None else F.lit(None).cast("string")
    status = F.when(F.col(body).isNull(), F.lit("no_page")).when(F.trim(body) == "", F.lit("empty"))
    if max_chars is not None:
        status = F.when(F.col(long), F.lit("error")).otherwise(status)
    if target_lang:
        status = F.when(status.isNull() & (F.coalesce(F.col(lang), F.lit("")) != primary_tag(target_lang)), F.lit("lang_mismatch")).otherwise(status)
    ok = status.isNull()
    told = F.when(ok, metadata_of("html", "url" if "url" in pages.columns else None)) if with_metadata else F.lit(None)
    if with_metadata and fmt not in ("markdown", "txt"):
        # a record reads every field: computed once
        out = with_computed(out, meta, told)
        told = F.col(meta)
    made = {
        "metadata": told, "status": F.coalesce(status, F.lit("ok")), "error": F.coalesce(too_long, F.col(failed)) if process_math else too_long,
        "format": F.lit(output_format), "content": F.when(ok, _as_format(out, body, fmt, meta if with_metadata else None)),
    }
    inner = {"html", body, long, known, lang, failed, meta, *made}
    # one projection: each further one would be analysed with all of these expressions again
    passed = [F.col("`" + c.replace("`", "``") + "`") for c in out.columns if c.lower() not in inner]
    return out.select(*passed, *[c.alias(name) for name, c in made.items()])


def _as_format(df: DataFrame, text: str, fmt: str, meta: str | None) -> Column:
    """Body text, or one JSON, XML or CSV record that holds text and metadata."""
    body = F.col(text)
    if fmt in ("markdown", "txt"):
        return body
    cols = []
    if meta:
        cols += [F.col(f"{meta}.{c}").alias(c) for c in ("title", "author", "date", "description", "sitename", "hostname", "language")]
        cols += [F.array_join(F.col(f"{meta}.{c}"), ";").alias(c) for c in ("categories", "tags")]
    if "url" in df.columns:
        cols.append(F.col("url"))
    record = F.struct(*cols, body.alias("text"))
    if fmt == "json":
        return F.to_json(record)
    if fmt == "csv":
        return F.to_csv(record, {"escape": '"'})
    return F.to_xml(record, {"rowTag": "doc"})


def drop_failed(results: DataFrame) -> DataFrame:
    """Only the pages that gave content."""
    return results.filter(F.col("status") == "ok")
