"""Repeated byte strings of whole texts, by prefix doubling over a sparse set of positions.

A string of ``length`` bytes counts as repeated if it also starts at another
place, in the same text or another one; bytes that a repeated string covers are
found.  Ranks of all positions would be many times the input, so positions are
chosen by content: every string has one anchor, the place of the least hash of a
quarter of its length within it.  Equal strings have their anchors at the same
offset, and an anchor's strings start in one short range.

1. Anchors are sorted by the hash of their quarter and that of all bytes their
   strings can reach.  Neighbours with the same reach are repeated with all their
   strings; an anchor whose quarter occurs nowhere else is unique and goes.
2. The anchors left have a grid of quarters about them.  Doubling gives each grid
   position the rank of its first one, two and four quarters: pairs of ranks, the
   second from the position as many bytes further, are counted, those that occur
   once go, the others are sorted over the cluster and ranked anew.
3. Strings that start between two grid positions share a core of three quarters,
   ranked by a pair as well.  Within a core's rank, the bytes before and after it are sorted
   and compared exactly.

Sorts are by ranges of all columns, so a group with a large share of the rows lies
in many tasks.  What a task cannot decide, as the group goes on in the next one,
it leaves to the following step, at last to a count of single strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch, arrow_ready, slices
from leafpress.operators.skew import ranked

#: Bytes of one long text that are hashed at once, and sorted rows looked at together.
PIECE = 2 << 20
CHUNK = 100_000
#: Bits of an anchor's packed place for each end of its range, which bounds ``length``.
RANGE_BITS = 12
FACTOR = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of ``width`` bytes, from those of stretches of 1, 2, 4 .. bytes."""
    part, size = _mixed(data.astype(np.uint64) + np.uint64(FACTOR)), 1
    whole, done = None, 0
    while True:
        if width & size:
            if whole is None:
                whole = part
            else:
                n = len(data) - done - size + 1
                whole = whole[:n] * np.uint64(pow(FACTOR, size, 1 << 64)) + part[done : done + n]
            done += size
        if 2 * size > width:
            return _mixed(whole)
        n = len(part) - size
        part = part[:n] * np.uint64(pow(FACTOR, size, 1 << 64)) + part[size:]
        size *= 2


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1]).ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, stops: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie one behind the other: place, first and last start of their strings, hash of the quarter."""
    width = length // 4
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    hashes = _rolling(data, width)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    place = (_least(keys, length - width + 1) & np.uint64(2**32 - 1)).astype(np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    inside = np.zeros(len(place) + 1, np.int32)
    fit = stops - starts >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, np.minimum(stops[fit] - length + 1, len(place)), -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return at, at, at, hashes[:0]
    new = np.flatnonzero((np.diff(place[at]) != 0) | (np.diff(at) != 1)) + 1
    first, last = at[np.concatenate([[0], new])], at[np.concatenate([new, [len(at)]]) - 1]
    return place[first], first, last, hashes[place[first]]


def _long_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one text in pieces; a range that two pieces share is one."""
    parts = []
    for a in range(0, max(len(data) - length + 1, 1), PIECE):
        piece = data[a : a + PIECE + length - 1]
        place, first, last, hashes = anchors_of(piece, np.array([len(piece)]), length)
        parts.append((place + a, first + a, last + a, hashes))
    place, first, last, hashes = (np.concatenate(c) for c in zip(*parts))
    own = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    ends = np.concatenate([own[1:], [len(place)]]) - 1 if len(place) else own
    return place[own], first[own], last[ends], hashes[own]


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    """Rows of anchors: ``t``, ``u`` (the text), ``at`` (place and range, packed), ``near`` (hash of the quarter), ``reach`` (hash of all that the strings can hold)."""
    names = ["t", "u", "at", "near", "reach"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        back = length - length // 4
        for part in slices(batches, "text"):
            column = part.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            stops = offsets[1:] - offsets[0]
            place, first, last, near = _long_anchors(data, length) if len(stops) == 1 else anchors_of(data, stops, length)
            if not len(place):
                continue
            doc = np.searchsorted(stops, place, side="right")
            starts = np.concatenate([[0], stops[:-1]])[doc]
            a, b = np.maximum(place - back, starts), np.minimum(place + length, stops[doc])
            raw, digest = memoryview(data), xxhash.xxh3_64_intdigest
            reach = np.fromiter((digest(raw[x:y], seed) for x, y, seed in zip(a.tolist(), b.tolist(), (place - a).tolist())), np.uint64, len(a))
            at = ((place - starts) << 2 * RANGE_BITS) | ((place - last) << RANGE_BITS) | (place - first)
            keys = [part.column(k).take(pa.array(doc)) for k in ("t", "u")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(at), pa.array(near.view(np.int64)), pa.array(reach.view(np.int64))], names=names)

    return texts.select("t", "u", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _place(at: Column) -> tuple[Column, Column, Column]:
    """Place of an anchor, and how far before it its last and its first string start."""
    mask = F.lit((1 << RANGE_BITS) - 1)
    return F.shiftright(at, 2 * RANGE_BITS), F.shiftright(at, RANGE_BITS).bitwiseAND(mask), at.bitwiseAND(mask)


def in_runs(rows: DataFrame, by: list[str], f: Callable[[dict[str, np.ndarray], bool, bool], pa.RecordBatch | None], schema: str, binary: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Sort ``rows``, a written table, by the columns ``by`` over the cluster and apply ``f`` to chunks of the sorted rows.

    Chunks end where the first column changes if they can.  ``f`` is told whether the first and the
    last group may go on beyond the chunk: at the ends of a task, and in groups of more than a chunk.
    With ``whole``, for groups of less than a chunk, rows are dealt by the first column and none does.
    """
    columns = rows.columns
    # as many slices as the table has splits, which grow with it
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())

    def arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(batches)
        return {c: table.column(c).combine_chunks() if c in binary else table.column(c).to_numpy() for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, open_before = 0, not whole

        def done(parts: list[pa.RecordBatch], open_after: bool):
            return f(arrays(parts), open_before, open_after)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK:
                continue
            key = np.concatenate([b.column(by[0]).to_numpy() for b in held])
            cut = np.flatnonzero(key[1:] != key[:-1])
            stop = int(cut[-1]) + 1 if len(cut) else size
            table = pa.Table.from_batches(held)
            out = done(table.slice(0, stop).combine_chunks().to_batches(), not len(cut))
            open_before = not len(cut)
            held = table.slice(stop).combine_chunks().to_batches() if stop < size else []
            size -= stop
            if out is not None:
                yield out
        if held:
            out = done(held, not whole)
            if out is not None:
                yield out

    dealt = rows.repartition(by[0]) if whole else rows.repartitionByRange(n, *by)
    return dealt.sortWithinPartitions(*by).mapInArrow(run, schema)


def _marked(anchors: DataFrame) -> DataFrame:
    """Anchors whose strings are all repeated (``done``), and one for each reach whose quarter has others beside it (``asks``, ``w``: 2 if it stands for many)."""

    def mark(c: dict[str, np.ndarray], open_before: bool, open_after: bool) -> pa.RecordBatch | None:
        new_near = np.concatenate([[True], c["near"][1:] != c["near"][:-1]])
        new = new_near | np.concatenate([[True], c["reach"][1:] != c["reach"][:-1]])
        same = ~new
        for k in ("t", "u", "at"):
            same[1:] &= c[k][1:] == c[k][:-1]
        group, reach = np.cumsum(new_near) - 1, np.cumsum(new) - 1
        many = (np.bincount(reach) > 1)[reach]
        others = np.bincount(group, new) > 1
        others[0] |= open_before
        others[-1] |= open_after
        asks = new & others[group]
        keep = np.flatnonzero((many & ~same) | asks)
        if not len(keep):
            return None
        weight = np.where(many, 2, 1)[keep]
        columns = [c[k][keep] for k in ("t", "u", "at")] + [many[keep], asks[keep], weight]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["t", "u", "at", "done", "asks", "w"])

    return in_runs(anchors, ["near", "reach", "t", "u", "at"], mark, "t long, u long, at long, done boolean, asks boolean, w long")


def _grids(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Anchors that ask, with the bytes of all their strings: ``a`` (a number of its own), t, u, place, lo, hi, w, bytes."""
    lists = asked.groupBy("t", "u").agg(F.collect_list(F.struct("at", "w")).alias("asked"))
    joined = texts.join(lists, ["t", "u"]).select("t", "u", F.col("asked.at").alias("ats"), F.col("asked.w").alias("ws"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, last = (1 << RANGE_BITS) - 1, None
        for part in slices(batches, "text", PIECE // 4):
            out: list[list] = [[], [], [], [], []]
            texts, ats, ws = part.column("text"), part.column("ats"), part.column("ws")
            for i, key in enumerate(zip(part.column("t").to_pylist(), part.column("u").to_pylist())):
                if key == last:  # a copy of the text before
                    continue
                last = key
                text = texts[i].as_py().encode()
                for at, w in zip(ats[i].as_py(), ws[i].as_py()):
                    p = at >> 2 * RANGE_BITS
                    cut = text[p - (at & mask) : p - (at >> RANGE_BITS & mask) + length]
                    for column, value in zip(out, (key[0], key[1], at, w, cut)):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["t", "u", "at", "w", "bytes"])

    grids = joined.mapInArrow(run, "t long, u long, at long, w long, bytes binary")
    place, lo, hi = _place(F.col("at"))
    return grids.select(
        F.monotonically_increasing_id().alias("a"), "t", "u", place.alias("place"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "w", "bytes"
    )


def _piece(start: Column, size: Column | int) -> Column:
    """Bytes from ``start``, an offset from the anchor, on."""
    return F.substring("bytes", (start + F.col("hi") + 1).cast("int"), F.lit(size) if isinstance(size, int) else size)


def _rerank(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Sort the pairs that occur at least twice at a grid position, and give their places as new ranks; unique positions go."""
    pairs = scratch.write(pairs, f"{name}_pairs")
    keys = ["g", "x", "y"]
    repeated = pairs.groupBy(*keys).agg(F.sum("w").alias("n")).filter("n > 1").select(*keys)
    names = scratch.write(ranked(repeated, [], keys, "rank"), f"{name}_names")
    done = scratch.write(pairs.join(names, keys).select("a", "w", "g", "rank"), name)
    scratch.drop(f"{name}_pairs")
    scratch.drop(f"{name}_names")
    return done


def _pairs(ranks: DataFrame, offset: int) -> DataFrame:
    """Of each grid position its rank and that ``offset`` positions further, if both are left."""
    own = ranks.groupBy("a", "w").agg(F.map_from_entries(F.collect_list(F.struct("g", "rank"))).alias("m"))
    row = F.explode(F.map_entries("m")).alias("e")
    pairs = own.select("a", "w", "m", row).select("a", "w", F.col("e.key").alias("g"), F.col("e.value").alias("x"), F.try_element_at("m", F.col("e.key") + offset).alias("y"))
    return pairs.filter("y is not null")


def _between(cells: DataFrame, quarter: int, scratch: Scratch) -> DataFrame:
    """Repeated strings that start between grid positions: ``a`` and from ``first`` to ``last`` their starts, offsets from the anchor.

    ``cells`` has a core's ``rank``, the grid position ``g`` of the core, and the bytes before and after it
    that strings of the anchor can hold.
    """

    def decide(c: dict[str, np.ndarray], open_before: bool, open_after: bool) -> pa.RecordBatch:
        rank, a, w, g = (c[k] for k in ("rank", "a", "w", "g"))
        n = len(rank)
        before, after = np.zeros((n, quarter), np.uint8), np.zeros((n, quarter), np.uint8)
        sizes = []
        for column, matrix, right in ((c["before"], before, True), (c["after"], after, False)):
            offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset).astype(np.int64)
            size = np.diff(offsets)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(n), size)
            within = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
            matrix[row, within + (quarter - size[row] if right else 0)] = data
            sizes.append(size)
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        group = np.cumsum(new) - 1
        left = np.zeros(group[-1] + 1, bool)
        left[0] |= open_before
        left[-1] |= open_after
        own = np.flatnonzero(~left[group])
        # equal surroundings count as one row with the sum of their weights
        pad = np.concatenate([before, after], 1)
        differs = new.copy()
        differs[1:] |= (pad[1:] != pad[:-1]).any(1)
        for size in sizes:
            differs[1:] |= size[1:] != size[:-1]
        alike = np.cumsum(differs) - 1
        weight = np.bincount(alike, w).astype(np.int64)
        first = np.flatnonzero(differs)
        first = first[~left[group[first]]]
        found = np.zeros((n, quarter), bool)
        factor = np.uint64(FACTOR)
        # hashes of the last bytes before the core and of the first ones after it, a byte more each time
        ends = np.zeros((quarter + 1, len(first)), np.uint64)
        for j in range(quarter - 1, 0, -1):
            ends[j] = ends[j + 1] * factor + before[first, j] + np.uint64(1)
        begin = _mixed(group[first].astype(np.uint64) + np.uint64(FACTOR))
        for j in range(1, quarter):
            begin = _mixed(begin * factor + after[first, j - 1])
            fit = np.flatnonzero((quarter - j <= sizes[0][first]) & (j <= sizes[1][first]))
            if not len(fit):
                continue
            key = _mixed(begin[fit] ^ _mixed(ends[j][fit]))
            order = np.argsort(key, kind="stable")
            rows = first[fit[order]]
            exact = np.concatenate([before[rows, j:], after[rows, :j]], 1)
            equal = (key[order][1:] == key[order][:-1]) & (group[rows][1:] == group[rows][:-1]) & (exact[1:] == exact[:-1]).all(1)
            run = np.cumsum(np.concatenate([[True], ~equal])) - 1
            found[rows, j] = (np.bincount(run, weight[alike[rows]]) > 1)[run]
        spread = np.zeros(alike[-1] + 1, np.int64)
        spread[alike[first]] = first
        found[own] = found[spread[alike[own]]]
        # runs of starts that are all repeated, one row each
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (at, begins), (_, ends) = np.nonzero(edges > 0), np.nonzero(edges < 0)
        rest = np.flatnonzero(left[group])
        none = np.zeros(len(rest), np.int64)
        offset = g[at] * quarter - quarter
        columns = [
            pa.array(np.concatenate([a[at], a[rest]])), pa.array(np.concatenate([offset + begins, none])), pa.array(np.concatenate([offset + ends - 1, none])),
            pa.array(np.concatenate([np.ones(len(at), bool), np.zeros(len(rest), bool)])),
            pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(rank[rest])]), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(g[rest])]),
            pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(w[rest])]),
            pa.concat_arrays([pa.nulls(len(at), pa.binary()), c["before"].take(pa.array(rest))]),
            pa.concat_arrays([pa.nulls(len(at), pa.binary()), c["after"].take(pa.array(rest))]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["a", "first", "last", "decided", "rank", "g", "w", "before", "after"]
    schema = "a long, first long, last long, decided boolean, rank long, g long, w long, before binary, after binary"
    seen = scratch.write(in_runs(cells, ["rank", "before", "after", "a"], decide, schema, ("before", "after")), "seen")
    # groups that lie in more than one task meet in one, if they are smaller than a chunk
    left = seen.filter(~F.col("decided")).drop("first", "last", "decided")
    sizes = scratch.write(left.groupBy("rank").agg(F.count(F.lit(1)).alias("n")), "sizes")
    left = scratch.write(left.join(sizes, "rank"), "left")
    met = in_runs(left.filter(F.col("n") < CHUNK).drop("n"), ["rank", "before", "after", "a"], decide, schema, ("before", "after"), whole=True)
    # of larger ones, each string is a row
    j = F.explode(F.sequence(F.lit(1), F.lit(quarter - 1))).alias("j")
    opened = left.filter(F.col("n") >= CHUNK).select("a", "rank", "g", "w", "before", "after", j)
    opened = opened.filter((F.lit(quarter) - F.col("j") <= F.octet_length("before")) & (F.col("j") <= F.octet_length("after")))
    missing = F.lit(quarter) - F.octet_length("before")
    ends = F.concat(F.substring("before", (F.col("j") - missing + 1).cast("int"), F.lit(quarter)), F.substring("after", F.lit(1), F.col("j")))
    opened = scratch.write(opened.select("a", "w", "rank", "j", "g", ends.alias("ends")), "opened")
    keys = ["rank", "j", "ends"]
    repeated = scratch.write(opened.groupBy(*keys).agg(F.sum("w").alias("n")).filter("n > 1").select(*keys), "opened_names")
    more = opened.join(repeated, keys).select("a", (F.col("g") * quarter - quarter + F.col("j")).cast("long").alias("first"))
    return seen.filter("decided").select("a", "first", "last").union(met.select("a", "first", "last")).union(more.withColumn("last", F.col("first")))


def find_repeats(df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """What is repeated in each row of ``df``: the id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (of the
    bytes that are left) and ``spans`` (maximal removed stretches of bytes: first, stop).

    ``length`` is a multiple of 4 from 8 to 4,096.  Texts are their UTF-8 bytes, a null text has none; strings
    do not cross texts.  The first occurrence is removed like any other, so equal rows of at
    least ``length`` bytes lose all; ids play no part and may be null or repeat.  An empty table gives
    no rows.  Texts are told apart by 128-bit hashes, anchors of one quarter by 64 further bits.
    """
    if length % 4 or not 8 <= length < 1 << RANGE_BITS:
        raise ValueError("length is a multiple of 4 from 8 to 4,092")
    quarter = length // 4
    spark = df.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "suffixes")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = df.select(F.col(f"`{id_}`").alias("id"), F.xxhash64(value).alias("t"), F.xxhash64(F.lit(7), value).alias("u"), value.alias("text"))
    rows = scratch.write(keyed.select("id", "t", "u", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "rows")
    texts = keyed.filter(F.octet_length("text") >= length).select("t", "u", "text")
    anchors = scratch.write(_anchors(texts, length), "anchors")
    marked = scratch.write(_marked(anchors), "marked")
    scratch.drop("anchors")
    grids = scratch.write(_grids(texts, marked.filter("asks").select("t", "u", "at", "w"), length), "grids")

    # quarters that lie within strings of the anchor, named by 128-bit hashes
    lo, hi = F.col("lo"), F.col("hi")
    g = F.explode(F.sequence(-F.floor(hi / quarter), F.floor((length - lo) / quarter) - 2)).alias("g")
    name = lambda k: F.unhex(F.md5(_piece((F.col("g") + k) * quarter, quarter)))
    pairs = grids.select("a", "w", "bytes", "hi", g).select("a", "w", "g", name(0).alias("x"), name(1).alias("y"))
    two = _rerank(pairs, scratch, "two")
    four = _rerank(_pairs(two, 2), scratch, "four")
    three = _rerank(_pairs(two, 1), scratch, "three")
    core = F.col("g") * quarter
    first, stop = F.greatest(core - quarter, -hi), F.least(core + length, length - lo)
    cells = three.drop("w").join(grids, "a").filter((first < core) & (stop > core + 3 * quarter)).select(
        "rank", "a", "w", "g", _piece(first, (core - first).cast("int")).alias("before"),
        _piece(core + 3 * quarter, (stop - core - 3 * quarter).cast("int")).alias("after"),
    )
    cells = scratch.write(cells, "cells")
    on_grid = (F.col("g") * quarter).cast("long")
    starts = _between(cells, quarter, scratch).union(four.select("a", on_grid.alias("first"), on_grid.alias("last")))
    starts = starts.join(grids.select("a", "t", "u", "place"), "a").select("t", "u", *[(F.col("place") + F.col(c)).alias(c) for c in ("first", "last")])

    place, near, far = _place(F.col("at"))
    whole = marked.filter("done").select("t", "u", (place - far).alias("first"), (place - near).alias("last"))
    copies = rows.groupBy("t", "u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "u")
    copies = scratch.write(copies, "copies")
    gone = whole.union(starts).groupBy("t", "u").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    gone = scratch.write(gone.join(copies, ["t", "u"], "left_anti").select("t", "u", F.col("starts.first").alias("firsts"), F.col("starts.last").alias("lasts")), "gone")
    spans_type = "array<struct<first:bigint,stop:bigint>>"
    told = scratch.write(_cut(texts.join(gone, ["t", "u"]), length, spans_type), "told")
    told = told.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    copied = F.coalesce("copy", F.lit(False)) & (F.col("n_bytes") >= length)
    result = rows.join(told, ["t", "u"], "left").select(
        F.col("id").alias(id_), "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        F.when(copied, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("stop"))))
        .otherwise(F.coalesce("spans", F.array().cast(spans_type))).alias("spans"),
    )
    return scratch.result(result)


def spans_of(firsts: np.ndarray, lasts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by strings that start from ``firsts`` to ``lasts``."""
    order = np.argsort(firsts, kind="stable")
    begins, stops = firsts[order], np.maximum.accumulate(lasts[order] + length)
    apart = np.flatnonzero(begins[1:] > stops[:-1])
    return list(zip(begins[np.concatenate([[0], apart + 1])].tolist(), stops[np.concatenate([apart, [len(stops) - 1]])].tolist()))


def _cut(asked: DataFrame, length: int, spans_type: str) -> DataFrame:
    """What is left of texts without the strings that start in their ranges."""
    schema = f"t long, u long, n_removed long, kept string, spans {spans_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            removed, kept, spans = [], [], []
            for text, firsts, lasts in zip(part.column("text"), part.column("firsts"), part.column("lasts")):
                data = memoryview(text.as_py().encode())
                own = spans_of(firsts.values.to_numpy(), lasts.values.to_numpy(), length)
                digest, at = hashlib.sha256(), 0
                for a, b in own:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                removed.append(sum(b - a for a, b in own))
                kept.append(digest.hexdigest())
                spans.append([{"first": a, "stop": b} for a, b in own])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
            columns = [part.column("t"), part.column("u"), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["t", "u", "n_removed", "kept", "spans"])

    return asked.mapInArrow(run, schema)
