"""How filters of whole texts overlap: what each removes, in every order of the filters.

One pass of a table-driven transducer over the UTF-8 bytes of a text counts its
words, capitals, code points and symbols.  The table is looked up by the classes of a
byte and the one before it, which is all the state that the machine has, so
many texts are passed at once.  The spans of words go into a hash table whose
hits are verified byte by byte; what it keeps are the distinct words.

Texts are read once, for a few bits of failures.  Everything else is counted on
the sets of failures, at most 32 for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch, arrow_ready, slices

FILTERS = "ABCDE"
#: Limits of the filters: words, percent of distinct words, percent of capitals; bytes of the symbols.
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = b"#$%&*|"

# classes of bytes
SPACE, CAPITAL, SYMBOL, FOLLOWS, OTHER = range(5)
# what a step counts
BEGINS, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8
#: Longer words are hashed and compared one by one.
LONG_WORD = 256


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[[0x20, *range(0x09, 0x0E)]] = SPACE
    table[ord("A") : ord("Z") + 1] = CAPITAL
    table[list(SYMBOLS)] = SYMBOL
    table[0x80:0xC0] = FOLLOWS
    return table


def _steps() -> np.ndarray:
    """What a byte counts, by the class of the one before it (8 times) and its own."""
    table = np.zeros(64, np.uint8)
    for before in range(5):
        for own in range(5):
            table[8 * before + own] = (
                BEGINS * (before == SPACE != own) | IS_CAPITAL * (own == CAPITAL) | IS_POINT * (own != FOLLOWS) | IS_SYMBOL * (own == SYMBOL)
            )
    return table


CLASSES, STEPS = _classes(), _steps()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Spans:
    """Words of a buffer, as places and sizes, with 64-bit hashes; tells whether two have the same bytes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
        self.raw, self.at, self.size = memoryview(data), at, size
        self.hashes = _mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        left, k = np.flatnonzero(size <= LONG_WORD), 0
        while len(left):
            self.hashes[left] = _mix(self.hashes[left] * np.uint64(0x9E3779B97F4A7C15) + self._eight(left, k))
            k += 1
            left = left[size[left] > 8 * k]
        long = np.flatnonzero(size > LONG_WORD)
        if len(long):
            import xxhash

            for i in long.tolist():
                self.hashes[i] = xxhash.xxh3_64_intdigest(self._bytes(i))

    def _eight(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of words, zeros beyond their ends."""
        rest = np.minimum(self.size[words] - 8 * k, 8).astype(np.uint64)
        return self.eights[self.at[words] + 8 * k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest))

    def _bytes(self, i: int) -> memoryview:
        return self.raw[self.at[i] : self.at[i] + self.size[i]]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (self.hashes[a] == self.hashes[b]) & (self.size[a] == self.size[b])
        left, k = np.flatnonzero(same & (self.size[a] <= LONG_WORD)), 0
        while len(left):
            hit = self._eight(a[left], k) == self._eight(b[left], k)
            same[left[~hit]] = False
            k += 1
            left = left[hit]
            left = left[self.size[a[left]] > 8 * k]
        for i in np.flatnonzero(same & (self.size[a] > LONG_WORD)).tolist():
            same[i] = a[i] == b[i] or self._bytes(a[i]) == self._bytes(b[i])
        return same


def distinct(spans: Spans, doc: np.ndarray) -> np.ndarray:
    """The first words, in no order, of each text's distinct ones: all are put into one open hash table side by side."""
    n = len(doc)
    bits = max(4, int(2 * n).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    mask = (1 << bits) - 1
    slot = (_mix(spans.hashes + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(mask)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        free = left[table[slot[left]] < 0]
        table[slot[free]] = free  # of several words for a slot, one stays
        owner = table[slot[left]]
        hit = owner == left
        others = np.flatnonzero(~hit)
        a, b = left[others], owner[others]
        hit[others] = (doc[a] == doc[b]) & spans.equal(a, b)
        left = left[~hit]
        slot[left] = (slot[left] + 1) & mask
    return table[table >= 0]


def passed(data: np.ndarray, stops: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of texts that lie one behind the other in ``data``: words, distinct words, capitals, code points, symbols."""
    n = len(stops)
    if not len(data):
        return {k: np.zeros(n, np.int64) for k in ("words", "distinct", "capitals", "points", "symbols")}
    starts = np.concatenate([[0], stops[:-1]])
    full = np.flatnonzero(stops > starts)
    own = CLASSES[data]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[starts[full]] = SPACE
    steps = STEPS[(before << 3) | own]
    doc_of = lambda places: np.searchsorted(stops, places, side="right")
    count = lambda flag: np.bincount(doc_of(np.flatnonzero(steps & flag)), minlength=n)
    at = np.flatnonzero(steps & BEGINS)
    word = own != SPACE
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = stops[full] - 1
    last[ends] = word[ends]
    size = np.flatnonzero(last) + 1 - at
    doc = doc_of(at)
    points = np.zeros(n, np.int64)
    points[full] = np.add.reduceat(((steps & IS_POINT) > 0).view(np.uint8), starts[full], dtype=np.int64)
    kept = distinct(Spans(data, at, size), doc)
    return {
        "words": np.bincount(doc, minlength=n), "distinct": np.bincount(doc[kept], minlength=n),
        "capitals": count(IS_CAPITAL), "points": points, "symbols": count(IS_SYMBOL),
    }


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``words``, ``distinct``, ``capitals``, ``points`` and ``symbols`` of it.

    A null text counts as empty.  Column names must differ from these five.
    """
    arrow_ready(df.sparkSession)
    kept = [c for c in df.columns if c != text]
    names = ["words", "distinct", "capitals", "points", "symbols"]
    shape = df.select(*kept, *[F.lit(0).cast("long").alias(c) for c in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            column = part.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            counts = passed(data, offsets[1:] - offsets[0])
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *(pa.array(counts[c]) for c in names)], names=shape.names)

    return df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, shape)


def failures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``id``, ``part`` and ``fails`` of documents (id, part, text): a bit for each filter, A the lowest.

    E compares whole texts by 128-bit hashes.  A document without an id is no
    smaller than any other, and no other is smaller than it.
    """
    text = F.coalesce("text", F.lit(""))
    counted = text_counts(docs.select("id", "part", F.xxhash64(text).alias("t"), F.xxhash64(F.lit(7), text).alias("u"), text.alias("text")))
    tests = [
        F.col("words") < LEAST_WORDS, 100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), F.col("symbols") > 0,
    ]
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    rows = scratch.write(counted.select("id", "part", "t", "u", bits.alias("bits")), "rows")
    first = rows.groupBy("t", "u").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("t", "u", "low")
    first = scratch.write(first, "first")
    late = F.when(F.col("id") > F.col("low"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, ["t", "u"], "left").select("id", "part", (F.col("bits") + late).alias("fails"))


def audit(df: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """For each part, order of the five filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley``, zeros included.

    ``labels`` has the columns ``id_``, ``quality`` and ``toxic``; of several rows for an id, one
    with a 1 is enough, and rows of an id that repeats in ``df`` all count.  A null part is the
    empty one, a null text is empty, an id that is null has no label.  An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "audit")
    docs = df.select(F.col(f"`{id_}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").cast("string").alias("text"))
    one = lambda c: F.max(F.when(F.col(f"`{c}`") == 1, 1).otherwise(0))
    told = labels.groupBy(F.col(f"`{id_}`").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0")
    rows = scratch.write(failures(docs, scratch), "fails").join(scratch.write(told, "labels"), "id", "left")
    sets = rows.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    return scratch.result(expanded(parts))


def expanded(parts: DataFrame) -> DataFrame:
    """Parts with their sets of failures (at most 32) to a row for each order and step."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    rows = parts.select("part", "sets", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    at = {f: F.instr("filter_order", f) for f in FILTERS}
    seen = sum((F.when(at[f] < F.col("step"), bit[f]).otherwise(0) for f in FILTERS), F.lit(0))
    own = sum((F.when(at[f] == F.col("step"), bit[f]).otherwise(0) for f in FILTERS), F.lit(0))
    rows = rows.withColumns({"seen": seen, "own": own})
    has = lambda s, mask: s["fails"].bitwiseAND(F.col(mask)) != 0

    def total(test, value=lambda s: s["n"]) -> Column:
        picked = F.transform(F.filter("sets", test), value)
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    removed = lambda s: has(s, "own") & ~has(s, "seen")
    orders_first = lambda s: (s["n"] * len(list(permutations(FILTERS))) / F.bit_count(s["fails"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda s: ~has(s, "own") & ~has(s, "seen")).alias("kept"), total(removed).alias("removed"),
        total(lambda s: has(s, "own") & has(s, "seen")).alias("redundant"), total(lambda s: s["fails"] == F.col("own")).alias("unique_fails"),
        total(removed, lambda s: s["good"]).alias("good_lost"), total(removed, lambda s: s["toxic"]).alias("toxic_lost"),
        total(lambda s: has(s, "own"), orders_first).alias("shapley"),
    )
