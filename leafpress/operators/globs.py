"""curl-style URL patterns: ``[1-9]``, ``[01-20:3]``, ``[a-f]``, ``{x,y}``.

Patterns are taken by kind: numbers, then letters, then lists, each from left to
right in the original URL.  A pattern is replaced at its first occurrence; a list
whose text changed because a range inside it was replaced stays as it is.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.functions import urls as U
from leafpress.functions.arrays import first_by, free_names, let
from leafpress.session import cut_lineage, shuffle_width

# The three pattern forms.
NUMBERS = r"\[(\d+)-(\d+)(?::(\d+))?\]"
LETTERS = r"\[[a-z]-[a-z]\]|\[[A-Z]-[A-Z]\]"
LISTS = r"\{([^}]+)\}"

IN_ROW = 4096
#: Numbers of a range; longer ones cannot be counted.
NUMBER = "decimal(37,0)"


def has_glob(url: Column) -> Column:
    return url.rlike(NUMBERS) | url.rlike(LETTERS) | url.rlike(LISTS)


def _pattern(text: Column, kind: str, start: Column, end: Column, step: Column, pad: Column, items: Column) -> Column:
    return F.struct(
        text.alias("pattern"), F.lit(kind).alias("type"), start.alias("start"), end.alias("end"),
        step.alias("step"), pad.alias("pad"), items.alias("items"),
    )


def glob_patterns(url: Column) -> Column:
    """All patterns of a URL as an array of structs, in the order they apply."""
    none, no_items = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    one, zero = F.lit(1).cast("long"), F.lit(0)

    def all_of(form: str) -> Column:
        return F.regexp_extract_all(url, F.lit(form), F.lit(0))

    def number(p: Column) -> Column:
        start, step = F.regexp_extract(p, NUMBERS, 1), F.regexp_extract(p, NUMBERS, 3)
        every = F.when(step == "", one).otherwise(step.try_cast("long"))
        return _pattern(p, "numeric_range", start, F.regexp_extract(p, NUMBERS, 2), every, F.length(start), no_items)

    numbers = F.transform(all_of(NUMBERS), number)
    letters = F.transform(
        all_of(LETTERS),
        lambda p: _pattern(p, "alpha_range", F.substr(p, F.lit(2), F.lit(1)), F.substr(p, F.lit(4), F.lit(1)), one, zero, no_items),
    )
    lists = F.transform(
        all_of(LISTS),
        lambda p: _pattern(
            p, "list", none, none, one, zero,
            F.transform(F.split(F.regexp_extract(p, LISTS, 1), ",", -1), lambda x: F.trim(x)),
        ),
    )
    return F.concat(numbers, letters, lists)


def pattern_size(p: Column) -> Column:
    """How many values a pattern has; NULL for a range that cannot be counted."""
    start, end, step = p["start"].try_cast(NUMBER), p["end"].try_cast(NUMBER), p["step"].cast(NUMBER)
    # without the remainder the division is exact
    steps = F.try_divide((end - start) - (end - start) % step, step)
    return (
        F.when(p["type"] == "list", F.size(p["items"]).cast("long"))
        .when(p["type"] == "alpha_range", F.greatest(F.ascii(p["end"]) - F.ascii(p["start"]) + 1, F.lit(0)).cast("long"))
        .when((p["step"] > 0) & (start > end), F.lit(0).cast("long"))
        .when(p["step"] > 0, F.try_add(steps.cast("decimal(38,0)"), F.lit(1)).try_cast("long"))
    )


def pattern_value(p: Column, i: Column) -> Column:
    """The i-th value (from 0) of a pattern; numbers padded to the start's width."""
    value = (p["start"].try_cast(NUMBER) + i.cast("decimal(19,0)") * p["step"].cast("decimal(19,0)")).cast("string")
    return (
        F.when(p["type"] == "list", F.get(p["items"], i.cast("int")))
        .when(p["type"] == "alpha_range", F.char(F.ascii(p["start"]) + i))
        .otherwise(let(value, lambda number: F.lpad(number, F.greatest(F.length(number), p["pad"]), "0")))
    )


def _put(url: Column, pattern: Column, value: Column) -> Column:
    """Replace the first occurrence only."""

    def replaced(at: Column) -> Column:
        whole = F.concat(F.substr(url, F.lit(1), at - 1), value, F.substr(url, at + F.length(pattern)))
        return F.when(at == 0, url).otherwise(whole)

    return let(F.instr(url, pattern), replaced)


def _nth(url: Column, places: Column, n: Column) -> Column:
    """URL number ``n`` of the product; the last pattern runs fastest."""
    return F.aggregate(
        places,
        url,
        lambda u, x: _put(u, x["p"]["pattern"], pattern_value(x["p"], F.expr("0L") + F.floor(n / x["below"]) % x["size"])),
    )


def prepared(df: DataFrame, url: str = "url") -> DataFrame:
    """Add patterns, their sizes and the number of combinations.

    ``glob_total`` is NULL if a range cannot be counted (step 0, a number of over
    37 digits, or more URLs than a 64-bit number counts): such a URL is rejected
    rather than ending the run.  The costly columns come out of generators of one
    row: Spark would copy the parsing of a plain column into filters on it, and into
    the lambda that makes each URL.
    """
    sizes = F.transform("glob_patterns", pattern_size)
    places = F.transform(
        "glob_patterns",
        lambda p, i: F.struct(
            p.alias("p"),
            F.get("glob_sizes", i).alias("size"),
            F.aggregate(
                F.slice("glob_sizes", i + 2, F.size("glob_sizes")), F.lit(1).cast("long"), lambda a, s: F.try_multiply(a, s)
            ).alias("below"),
        ),
    )
    total = F.aggregate("glob_sizes", F.lit(1).cast("decimal(38,0)"), lambda a, s: F.try_multiply(a, s.cast("decimal(20,0)")).try_cast("decimal(38,0)"))
    return (
        df.withColumn("glob_patterns", F.explode(F.array(glob_patterns(F.col(url)))))
        .withColumn("glob_sizes", F.explode(F.array(sizes)))
        .withColumn("glob_places", F.explode(F.array(places)))
        .withColumn("glob_total", F.when(F.exists("glob_sizes", lambda s: s == 0), F.lit(0)).otherwise(total).try_cast("long"))
    )


def rejected_globs(df: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose URL has a pattern that cannot be counted."""
    return prepared(df, url).filter("glob_total IS NULL").select(*df.columns)


def expand_globs(df: DataFrame, url: str = "url", in_row: int = IN_ROW) -> DataFrame:
    """One row per distinct URL of each row, in place of ``url``, with ``ordinal``.

    ``ordinal`` is the place of a URL's first occurrence in the product.  Small
    products are unrolled and made distinct inside the row.  A large product is
    cut into pieces that go to different tasks, and made distinct by grouping,
    so one URL may stand for more rows than a task could hold.  The few rows with
    large products are written with a number first, so that equal rows stay apart
    and their other columns may be of any kind.  Rows that cannot be counted are
    in ``rejected_globs``.  A line is short and its product may be long, so the rows
    are dealt out first: a list of a few megabytes would be one task's.
    """
    ready = prepared(df.repartition(shuffle_width(df.sparkSession)), url)
    others = [c for c in df.columns if c != url]
    last = F.col("glob_total") - 1

    def numbered(n: Column) -> Column:
        return _nth(F.col(url), F.col("glob_places"), n)

    unrolled = F.transform(
        F.sequence(F.lit(0).cast("long"), last), lambda n: F.struct(n.alias("ordinal"), numbered(n).alias("url"))
    )
    small = (
        ready.filter(F.col("glob_total").between(1, in_row))
        .select(*others, F.explode(first_by(unrolled, lambda e: e["url"])).alias("e"))
        .select(*others, F.col("e.url").alias(url), F.col("e.ordinal").alias("ordinal"))
    )
    big = cut_lineage(ready.filter(F.col("glob_total") > in_row).withColumn("_row", F.monotonically_increasing_id()))

    def pieces(size: int, begin: Column, end: Column) -> Column:
        return F.explode(F.sequence(begin, F.least(end, last), F.lit(size).cast("long")))

    zero = F.lit(0).cast("long")
    step1, step2 = in_row * in_row, in_row
    cut = big.select("_row", url, "glob_places", "glob_total")
    cut = cut.withColumn("_a", pieces(step1, zero, last)).withColumn("_b", pieces(step2, F.col("_a"), F.col("_a") + step1 - 1))
    rows = (
        cut.repartition("_row", "_b")
        .withColumn("ordinal", pieces(1, F.col("_b"), F.col("_b") + step2 - 1))
        .select("_row", numbered(F.col("ordinal")).alias("_url"), "ordinal")
    )
    distinct = rows.groupBy("_row", "_url").agg(F.min("ordinal").alias("ordinal"))
    if others:
        distinct = distinct.join(big.select("_row", *others), "_row")
    return small.unionByName(distinct.select(*others, F.col("_url").alias(url), "ordinal"))


def expand_urls(df: DataFrame, url: str = "url", ignore_glob: bool = False) -> DataFrame:
    """Expanded URLs that have a scheme and a host; untouched with ``ignore_glob``."""
    if ignore_glob:
        return df.withColumn("ordinal", F.lit(0).cast("long"))
    return expand_globs(df, url).filter(U.has_scheme_and_host(F.col(url)))


def expand_list(lines: DataFrame, url: str = "url", ignore_glob: bool = False, keep_rejected: bool = False) -> DataFrame:
    """A whole URL list: pattern lines expanded and validated, others as they are.

    URLs are made distinct within a line only, not across lines.  With
    ``ignore_glob`` patterns are URLs like any other.  With ``keep_rejected`` a
    column ``status`` tells ``ok`` from ``rejected``: a pattern line that cannot be
    counted, or gives no URL with a scheme and a host, stays as it is, with ordinal 0.
    """
    zero = F.lit(0).cast("long")
    if ignore_glob:
        every = lines.withColumn("ordinal", zero)
        return every.withColumn("status", F.lit("ok")) if keep_rejected else every
    is_glob = has_glob(F.col(url))
    found = lines.filter(~is_glob).withColumn("ordinal", zero).unionByName(expand_urls(lines.filter(is_glob), url))
    if not keep_rejected:
        return found
    # scheme and host are as in the pattern, unless a list stands before the path
    first = _nth(F.col(url), F.col("glob_places"), zero)
    none = F.col("glob_total").isNull() | ((F.col("glob_total") > 0) & ~U.has_scheme_and_host(first))
    doubted = prepared(lines.filter(is_glob), url).filter(none).select(*lines.columns)
    # such a list may give good URLs all the same: a line of which any is good is no rejected one
    (pattern,) = free_names(lines, "_pattern")
    kept = expand_urls(doubted.withColumn(pattern, F.col(url)), url).drop(url, "ordinal").withColumnRenamed(pattern, url).select(*lines.columns).distinct()
    kept = kept.toDF(*[f"_kept{i}" for i in range(len(lines.columns))])
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"_kept{i}")) for i, c in enumerate(lines.columns)])
    bad = doubted.join(kept, same, "left_anti").withColumn("ordinal", zero)
    return found.withColumn("status", F.lit("ok")).unionByName(bad.withColumn("status", F.lit("rejected")))


def expansion_counts(expanded: DataFrame, by: list[str]) -> DataFrame:
    return expanded.groupBy(*by).agg(F.count(F.lit(1)).alias("n_urls"))
