"""Repeated passages of whole texts, found by recompression.

A window is a number of consecutive words of one document.  A word is removed if
a window that covers it also starts in a document with a smaller id.

Recompression names symbols in rounds: runs of equal symbols, then pairs of a
left and a right symbol (the sides come from the names), get one name made of
theirs.  A name is a 64-bit hash of what it stands for, so all tasks give it
alike and a round needs no exchange; nothing is decided by names alone.  As spans
are bounded, what a symbol is depends on few words about it (``reach``): inside
a window, but for its ends, equal text gives equal symbols.  Of these, every
stretch of symbols that fits in the inner part of a window sends its least one:
the high-level symbol, named with the words within reach of it, which each such
window holds.  So a repeated window shares a high-level symbol with its other
occurrence, always, and unrelated texts hardly ever share one.

The names that two documents share go back to their documents.  Only the windows
whose own high-level symbol is shared are compared, by 128-bit hashes of their words; the
smallest id with a window decides.  Exact copies are told by a digest of their
words first, and need no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.llm.common import Scratch, arrow_ready, slices

#: Spans allowed after the run step and after each pair step.
RUN_SPAN = 2
PAIR_SPANS = (3, 4)
#: Odd factors of the rolling hashes, their inverses modulo 2^64, and seeds of the word hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEEDS = (1, 2)
#: Words whose hashes a worker keeps.
CACHED = 200_000


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Plan:
    """How far the rounds reach for windows of a size: few rounds where windows are short."""

    def __init__(self, window: int):
        if window < 2:
            raise ValueError("a window has two words at least")
        self.window, self.run, self.pairs, self.reach, self.span = window, 0, (), 0, 1
        if window >= 12 * RUN_SPAN:
            # a boundary depends on the symbols at its sides, they on theirs
            self.run, self.pairs, self.reach, self.span = RUN_SPAN, PAIR_SPANS, RUN_SPAN, RUN_SPAN
            for span in PAIR_SPANS:
                self.reach, self.span = self.reach + self.span, span
        # the first whole symbol of the inner part begins at reach + span - 1 at the latest
        self.inner = window - 2 * self.reach - self.span + 1


def _runs(name, start, span, limit):
    same = (name[1:] == name[:-1]) & (start[:-1] + span[:-1] == start[1:])
    begin = np.concatenate([[True], ~same])
    at = np.flatnonzero(begin)
    times = np.diff(np.append(at, len(name)))
    whole = (times > 1) & (times * span[at] <= limit)
    if not whole.any():
        return name, start, span
    name, span = name.copy(), span.copy()
    one = at[whole]
    name[one] = _mix(_mix(name[one], 101) + times[whole].astype(np.uint64), 102)
    span[one] *= times[whole]
    keep = begin | ~np.repeat(whole, times)
    return name[keep], start[keep], span[keep]


def _pairs(name, start, span, limit, number):
    left = (_mix(name, 200 + number) & np.uint64(1)) == 0
    pair = left[:-1] & ~left[1:] & (start[:-1] + span[:-1] == start[1:]) & (span[:-1] + span[1:] <= limit)
    first, second = np.append(pair, False), np.append(False, pair)
    name, span = name.copy(), span.copy()
    name[first] = _mix(_mix(name[first], 300 + number) ^ (name[second] * np.uint64(FACTORS[1])), 400 + number)
    span[first] += span[second]
    return name[~second], start[~second], span[~second]


def _least(value: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Index of the least value (the first of equals) in [i, stop[i]) for each i."""
    n = len(value)
    own = np.arange(n)
    length = stop - own
    level = np.floor(np.log2(length)).astype(np.int64)
    best = own.copy()
    out = np.empty(n, np.int64)
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        a, b = best[at], best[stop[at] - (1 << k)]
        out[at] = np.where((value[b] < value[a]) | ((value[b] == value[a]) & (b < a)), b, a)
        if (1 << k) < n:
            a, b = best[: n - (1 << k)], best[1 << k :]
            best = best.copy()
            best[: n - (1 << k)] = np.where(value[b] < value[a], b, a)
    return out


def _powers(factor: int, n: int) -> np.ndarray:
    powers = np.full(n, factor, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


class Rolling:
    """Hashes of stretches of words, from running sums over all words of a batch."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, factor: int):
        n = len(words)
        known = self._powers.get(factor)
        if known is None or len(known[0]) <= n:
            size = max(n + 1, 1 << 19)
            known = tuple(_powers(f, size) for f in (factor, pow(factor, -1, 1 << 64)))
            if size <= 1 << 20:
                self._powers[factor] = known
        self.inverse = known[1]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * known[0][:n], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def hash_words(texts: list[list[bytes]], seed: int, cache: dict[bytes, int]) -> np.ndarray:
    import xxhash

    if len(cache) > CACHED:
        cache.clear()
    fresh = {w for words in texts for w in words} - cache.keys()
    digest = xxhash.xxh3_64_intdigest
    cache.update((w, digest(w, seed)) for w in fresh)
    return np.array([cache[w] for words in texts for w in words], np.uint64)


class HighSymbols:
    """The high-level symbols of texts given by their word hashes.

    ``name``, ``text``: of each symbol; the words it stands for, with those within
    reach, are words of its text.  Words are counted over all texts of the batch.
    """

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, plan: Plan):
        self.plan, self.gap, self.sizes = plan, plan.window + 1, sizes
        self.begins = np.concatenate([[0], np.cumsum(sizes)])
        self.name, self.text = np.empty(0, np.uint64), np.empty(0, np.int64)
        n = len(hashes)
        if not n:
            return
        text = np.repeat(np.arange(len(sizes)), sizes)
        name, start, span = _mix(hashes), np.arange(n) + text * self.gap, np.ones(n, np.int64)
        if plan.run:
            name, start, span = _runs(name, start, span, plan.run)
            for number, limit in enumerate(plan.pairs):
                name, start, span = _pairs(name, start, span, limit, number)
        stop = np.searchsorted(start + span, start + plan.inner, side="right")
        self.start = start
        self.least = _least(_mix(name, 500), np.maximum(stop, np.arange(len(name)) + 1))
        chosen = np.unique(self.least)
        # back from places with gaps between texts to places in the batch
        of = np.searchsorted(self.begins[1:] + np.arange(len(sizes)) * self.gap, start[chosen], side="right")
        first = start[chosen] - of * self.gap - plan.reach
        last = first + span[chosen] + 2 * plan.reach
        inside = (first >= self.begins[of]) & (last <= self.begins[of + 1])
        self.symbol, self.text = chosen[inside], of[inside]
        first, last = first[inside], last[inside]
        self.name = _mix(Rolling(hashes, FACTORS[0])(first, last) + (last - first).astype(np.uint64), 600)

    def windows(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and texts of the windows whose own high-level symbol is ``known`` (one flag for each symbol).

        A window's own is the least of the symbols in its inner part, from the first that begins there.
        """
        if not known.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        number = np.maximum(self.sizes - self.plan.window + 1, 0)
        text = np.repeat(np.arange(len(number)), number)
        place = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + self.begins[text]
        own = self.least[np.searchsorted(self.start, place + text * self.gap + self.plan.reach, side="left")]
        wanted = np.zeros(len(self.start), bool)
        wanted[self.symbol[known]] = True
        return place[wanted[own]], text[wanted[own]]


def _words(column: pa.Array) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split() for t in column.to_pylist()]


def _symbols(df: DataFrame, plan: Plan) -> DataFrame:
    """For each row (id, o, t, text): words, digest of the words and the names of the high-level symbols."""
    schema = df.select("id", "o", "t").withColumns({"n_words": F.lit(0).cast("long"), "digest": F.lit("").cast("string"), "names": F.array().cast("array<long>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for part in slices(batches, "text"):
            texts = _words(part.column("text"))
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in texts]
            sizes = np.array([len(w) for w in texts])
            long = sizes >= plan.window
            some = [w for w, x in zip(texts, long) if x]
            found = HighSymbols(hash_words(some, SEEDS[0], cache), sizes[long], plan)
            names, edges = found.name, np.searchsorted(found.text, np.arange(len(some) + 1))
            lists: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
            for i, a, b in zip(np.flatnonzero(long), edges, edges[1:]):
                lists[i] = np.unique(names[a:b]).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            kept = [part.column(c) for c in ("id", "o", "t")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), column], names=schema.names)

    return df.mapInArrow(run, schema)


def _windows(df: DataFrame, plan: Plan) -> DataFrame:
    """The windows of rows (o, t, text, shared) whose own high-level symbol is shared: h1, h2, o, t, start, more.

    Equal windows of one text, as a repeated line gives many, are one row with the
    first start; the others are in ``more``, which is null where there are none.
    """
    longs = [F.lit(0).cast("long").alias(c) for c in ("h1", "h2")]
    schema = df.select(*longs, "o", "t", F.lit(0).alias("start"), F.lit(None).cast("array<int>").alias("more")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches: tuple[dict[bytes, int], ...] = ({}, {})
        for part in slices(batches, "text"):
            texts = _words(part.column("text"))
            sizes = np.array([len(w) for w in texts])
            hashes = [hash_words(texts, seed, cache) for seed, cache in zip(SEEDS, caches)]
            symbols = HighSymbols(hashes[0], sizes, plan)
            shared = part.column("shared")
            owner = np.repeat(np.arange(len(texts)), shared.value_lengths().to_numpy(zero_copy_only=False))
            flat = shared.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            # a name counts in its own text only
            known = np.isin(_mix(symbols.name) + symbols.text.astype(np.uint64), _mix(flat) + owner.astype(np.uint64))
            starts, text = symbols.windows(known)
            begins = symbols.begins
            h1, h2 = (_mix(Rolling(h, f)(starts, starts + plan.window)).view(np.int64) for h, f in zip(hashes, FACTORS))
            order = np.lexsort((starts, h2, h1, text))
            h1, h2, text, starts = h1[order], h2[order], text[order], (starts - begins[text]).astype(np.int32)[order]
            first = np.ones(len(starts), bool)
            first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (text[1:] != text[:-1])
            others = np.diff(np.append(np.flatnonzero(first), len(starts))) - 1
            ends = np.concatenate([[0], np.cumsum(others)])
            more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(starts[~first]), mask=pa.array(others == 0))
            at = pa.array(text[first])
            columns = [pa.array(h1[first]), pa.array(h2[first]), part.column("o").take(at), part.column("t").take(at), pa.array(starts[first]), more]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Stretches (first, last + 1) of the words that windows at ``starts`` cover."""
    starts = np.unique(starts)
    apart = np.flatnonzero(np.diff(starts) > window)
    firsts, lasts = starts[np.concatenate([[0], apart + 1])], starts[np.concatenate([apart, [len(starts) - 1]])]
    return [(int(a), int(b) + window) for a, b in zip(firsts, lasts)]


def find_repeats(df: DataFrame, id_: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """What is removed from each row of ``df``: the id, ``t`` (hash of the text), ``n_words``, ``n_removed``,
    ``kept_sha256`` (of the kept words, joined by one space) and ``spans`` (stretches of removed words: first, stop).

    A null text has no words.  Windows are judged on the input.  Rows of equal id
    are no smaller than each other; a null id is larger than all others.
    """
    plan = Plan(window)
    arrow_ready(df.sparkSession)
    scratch = Scratch(df.sparkSession, "repeats")
    id_column = F.col(f"`{id_}`")
    if isinstance(df.schema[id_].dataType, T.IntegralType):
        order = F.coalesce(id_column.cast("long"), F.lit(2**63 - 1))
    else:  # any other ordered type
        order = F.struct(id_column.isNull().alias("none"), id_column.alias("id"))
    texts = df.select(id_column.alias("id"), order.alias("o"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    rows = scratch.write(_symbols(texts, plan), "rows")
    first = rows.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("o").alias("first"))
    marked = rows.select("id", "o", "t", "n_words", "digest").join(first, "digest", "left")
    marked = scratch.write(marked.select("id", "o", "t", "n_words", "digest", F.coalesce(F.col("first") < F.col("o"), F.lit(False)).alias("copy")), "marked")
    originals = marked.filter(~F.col("copy") & (F.col("n_words") >= window)).select("o", "t").distinct()
    names = rows.select("o", "t", "names").join(originals, ["o", "t"], "left_semi").select("o", F.explode("names").alias("name"))
    names = scratch.write(names, "names")
    scratch.drop("rows")
    shared = names.groupBy("name").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low < high").select("name")
    wanted = names.join(shared, "name").groupBy("o").agg(F.collect_set("name").alias("shared"))
    wanted = originals.join(wanted, "o")
    asked = scratch.write(texts.select("o", "t", "text").join(wanted, ["o", "t"]), "asked")
    scratch.drop("names")
    windows = scratch.write(_windows(asked, plan), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low < high").select("h1", "h2", "low")
    starts = F.concat(F.collect_list("start"), F.flatten(F.collect_list("more")))
    gone = windows.join(least, ["h1", "h2"]).filter("low < o").groupBy("o", "t").agg(starts.alias("starts"))
    cut = asked.select("o", "t", "text").join(gone, ["o", "t"])
    spans_type = "array<struct<first:int,stop:int>>"
    schema = cut.select("o", "t", F.lit(0).cast("long").alias("gone"), F.lit("").alias("left"), F.lit(None).cast(spans_type).alias("spans")).schema

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            removed, digests, spans = [], [], []
            for words, starts in zip(_words(part.column("text")), part.column("starts")):
                own = spans_of(starts.values.to_numpy(zero_copy_only=False), window)
                edges = [0, *(x for s in own for x in s), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                spans.append([{"first": a, "stop": b} for a, b in own])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
            columns = [part.column("o"), part.column("t"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    done = scratch.write(cut.mapInArrow(kept, schema).dropDuplicates(["o", "t"]), "done")
    scratch.drop("windows")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("stop")))
    none = F.array().cast(spans_type)
    result = marked.join(done, ["o", "t"], "left").select(
        F.col("id").alias(id_), "t", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "digest")).alias("kept_sha256"),
        F.when(F.col("copy"), whole.cast(spans_type)).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
    return scratch.result(result)


def without_repeats(df: DataFrame, id_: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """The rows of ``df`` without their repeated passages, all columns kept; rows of which no word is left go.

    A removed word takes the white space after it along; texts that lose nothing stay
    as they are, empty ones too.
    """
    found = find_repeats(df, id_, text, window).filter("n_removed > 0").select(
        F.col(id_).alias("found_id"), "t", "spans", (F.col("n_removed") == F.col("n_words")).alias("none")
    ).dropDuplicates(["found_id", "t"])
    # columns go by number, so none of the caller's can clash with ours
    own = [f"c{i}" for i in range(len(df.columns))]
    schema = df.schema
    at = df.columns.index(text)
    cut = df.toDF(*own).withColumn("hash", F.xxhash64(own[at]))
    on = [F.col(own[df.columns.index(id_)]).eqNullSafe(F.col("found_id")), F.col("hash") == F.col("t")]
    cut = cut.join(found, on, "left").filter(~F.coalesce("none", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        piece = re.compile(r"[^ \t-\r]+[ \t-\r]*")
        for part in slices(batches, own[at]):
            texts = part.column(at).to_pylist()
            for i, spans in enumerate(part.column(len(schema)).to_pylist()):
                if spans:
                    pieces = piece.findall(texts[i])
                    edges = [0, *(x for s in spans for x in (s["first"], s["stop"])), len(pieces)]
                    texts[i] = "".join(p for a, b in zip(edges[::2], edges[1::2]) for p in pieces[a:b])
            columns = [pa.array(texts, part.column(at).type) if i == at else part.column(i) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut.select(*own, "spans").mapInArrow(run, schema)
