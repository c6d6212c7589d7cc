"""Array helpers built from higher-order functions.

They let a page be worked on inside its own row, so that per-page jobs need no
shuffle.  All are linear (or n log n) in the array length but ``scan``, whose outer
fold copies what it has put out once for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(make: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expressions that ``make`` builds for plain arguments.

    An expression names its columns and belongs to no DataFrame, so it can be
    used again; building a large one takes seconds of driver time.  Kept per
    Spark context.
    """
    kept: dict = {}

    @wraps(make)
    def wrapper(*args):
        context = SparkContext._active_spark_context
        key = (id(context), getattr(context, "applicationId", None), args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return wrapper


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where ``df`` has such columns already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row.

    Filters on a plain projected column are pushed below the projection, which
    copies its expression into the filter.  They stop at a generator, here one
    that gives a single row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def scan(arr: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column], Column]) -> Column:
    """Running fold: one integer, made by ``emit``, of the state after each element.

    Every step copies what was put out so far, so the output is kept to plain
    integers and the input is walked in chunks: an inner fold over at most 128
    elements and an outer one over the chunks.
    """

    def chunked(a: Column) -> Column:
        n_chunks = F.ceil(F.size(a) / F.lit(float(_CHUNK))).cast("int")
        return F.transform(
            F.sequence(F.lit(1), F.greatest(n_chunks, F.lit(1))),
            lambda c: F.slice(a, (c - 1) * _CHUNK + 1, _CHUNK),
        )

    def fold(chunk: Column, start: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(start.alias("s"), F.expr("cast(array() as array<bigint>)").alias("o")),
            lambda acc, x: let(
                step(acc["s"], x),
                lambda s: F.struct(s.alias("s"), F.array_append(acc["o"], emit(s).cast("bigint")).alias("o")),
            ),
        )

    folded = F.aggregate(
        let(arr, chunked),
        F.struct(zero.alias("s"), F.expr("cast(array() as array<bigint>)").alias("o")),
        lambda acc, chunk: let(
            fold(chunk, acc["s"]),
            lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], r["o"]).alias("o")),
        ),
        lambda acc: acc["o"],
    )
    return folded


def first_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element of each key, in order (n log n)."""

    def by_sort(a: Column) -> Column:
        keyed = F.sort_array(F.transform(a, lambda e, i: F.struct(key(e).alias("k"), i.alias("i"))))
        firsts = let(
            keyed,
            lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"])),
        )
        order = F.sort_array(F.transform(firsts, lambda e: e["i"]))
        return F.transform(order, lambda i: F.get(a, i))

    return let(
        arr,
        lambda a: F.when(F.size(F.array_distinct(F.transform(a, key))) == F.size(a), a).otherwise(by_sort(a)),
    )


def replace_each(text: Column, pattern: str, repl: Callable[[Column], Column]) -> Column:
    """Regex replace whose replacement is an expression of the match."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.when(hit.isNull(), gap).otherwise(F.concat(gap, repl(hit))),
    )
    return F.array_join(pieces, "")


def collapse_spaces(text: Column) -> Column:
    """White space runs to one blank, ends trimmed; single blanks are not touched."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x{00a0}]{2,}|[\t\r\n\f\x{00a0}]", " "))


# The characters that str.strip takes off.
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Take white space off both ends."""
    return F.btrim(text, F.lit(_BLANKS))
