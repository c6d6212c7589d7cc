"""Near-duplicate vectors by spherical-cap filters.

A filter direction is a code word of a random product code: the vector space,
turned by a seeded rotation, is cut into two halves, each half has a number of
random unit vectors, and every pair of them is a direction.  A vector is decoded
to the list of all directions whose inner product with it exceeds a level that only hangs
on the code and the dimension (``ProductCode.level``: a random vector exceeds ``TAKEN``
directions on average).  Where it exceeds fewer than ``LEAST_TAKEN``, these best ones are its list.
Of each half only words are looked at that can exceed the level with the other
half's best one.  That is done for ``CODES`` independent codes; the more vectors, the
more words a half has (``words_for``), so caps do not grow with the table.

In fewer than ``LEAST_DIMENSION`` dimensions codes are too coarse.  There, and with ``exact``, vectors
meet in the cells of a grid over their first turned coordinates: two unit vectors as
near as ``least`` asks for differ by less than the cell width in every coordinate, so
the smaller node sends itself to the neighbouring cells within reach and no link is lost.

Vectors with the same label meet in the caps or cells they share and are verified
there in double precision; a pair counts in the first cap that it shares.  Equal
vectors are one class with a count.  A cap gives each class its number of links and the
links of a spanning forest, so a group of near copies gives rows in proportion to its
members.  Large caps are split into blocks that meet in pairs.  Links that the codes
miss are less than one in a thousand at the least similarity; a test measures it from 2 to 1,024 dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch, arrow_ready
from leafpress.llm.components import components
from leafpress.llm.grouped import Forest, in_blocks, over_groups

#: Directions that a random vector exceeds in one code, on average and at least; number of codes.
TAKEN = 6
LEAST_TAKEN = 6
CODES = 2
#: Words of a half of a code, and vectors for which these are enough.
WORDS = 128
VECTORS = 4_000_000
#: Dimensions from which on codes are used, and coordinates of the grid below.
LEAST_DIMENSION = 12
GRID = 3


def words_for(vectors: int) -> int:
    """Words of a half: twice as many for four times the vectors, so a cap's share falls as the table grows."""
    words = WORDS
    while VECTORS * (words // WORDS) ** 2 < vectors:
        words *= 2
    return words


class ProductCode:
    """Decodes unit vectors of one dimension; the same on every worker."""

    _made: dict[tuple[int, int, int], ProductCode] = {}

    def __init__(self, dimension: int, seed: int, words: int = WORDS):
        rng = np.random.default_rng([seed, dimension])
        self.size = words
        # with more words, a direction is shared more seldom, and more are taken
        self.taken = TAKEN + 3 * int(np.log2(words // WORDS))
        self.least = min(LEAST_TAKEN + 3 * int(np.log2(words // WORDS)), words)
        self.turns = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(CODES)]
        half = dimension // 2
        self.parts = [slice(0, half), slice(half, dimension)]
        self.words = []
        for _ in range(CODES):
            own = [rng.standard_normal((words, p.stop - p.start)) for p in self.parts]
            self.words.append([w / np.linalg.norm(w, axis=1, keepdims=True) for w in own])
        # of two falling lists, the best sums lie at places i, j with (i + 1) (j + 1) <= least
        self.pairs = np.array([(i, j) for i in range(self.least) for j in range(self.least) if (i + 1) * (j + 1) <= self.least])
        sample = rng.standard_normal((256, dimension))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        one, two = self._scores(sample, 0)
        every = (one[:, :, None] + two[:, None, :]).reshape(len(sample), -1)
        #: Inner product from which on a direction is exceeded.
        self.level = float(np.quantile(every, 1 - self.taken / words**2))

    @classmethod
    def of(cls, dimension: int, seed: int, words: int = WORDS) -> ProductCode:
        key = (dimension, seed, words)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def _scores(self, unit: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.turns[code]
        return tuple(turned[:, part] @ own.T for part, own in zip(self.parts, self.words[code]))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Rows of sorted numbers of the directions that each vector exceeds, filled up with -1 on the left."""
        rows, numbers = [], []
        chunk = max(16, 512 * WORDS**2 // self.size**2)
        for a in range(0, len(unit), chunk):
            part = unit[a : a + chunk]
            for code in range(CODES):
                lists = []
                for s in self._scores(part, code):
                    order = np.argsort(-s, axis=1, kind="stable")
                    lists.append((order, np.take_along_axis(s, order, 1)))
                (first, one), (second, two) = lists
                # the best few, whatever the level
                i, j = self.pairs.T
                total = one[:, i] + two[:, j]
                best = np.argsort(-total, axis=1, kind="stable")[:, : self.least]
                at = np.repeat(np.arange(len(part)), best.shape[1])
                picks = [(at, np.take_along_axis(first[:, i], best, 1).ravel(), np.take_along_axis(second[:, j], best, 1).ravel())]
                # all that exceed it: words that can with the other half's best one
                wide = int((one + two[:, :1] >= self.level).sum(1).max(initial=0)), int((two + one[:, :1] >= self.level).sum(1).max(initial=0))
                if min(wide):
                    at, x, y = np.nonzero(one[:, : wide[0], None] + two[:, None, : wide[1]] >= self.level)
                    picks.append((at, first[at, x], second[at, y]))
                for at, x, y in picks:
                    rows.append(at + a)
                    numbers.append((code * self.size + x) * self.size + y)
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(numbers)], 1), axis=0)
        sizes = np.bincount(pairs[:, 0], minlength=len(unit))
        width = int(sizes.max(initial=0))
        out = np.full((len(unit), width), -1, np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out[pairs[:, 0], np.arange(len(pairs)) - begins[pairs[:, 0]] + (width - sizes)[pairs[:, 0]]] = pairs[:, 1]
        return out


def cells(unit: np.ndarray, least: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells of unit vectors: their own, and rows of all cells that a vector as near as ``least`` can lie in, filled up with -1.

    Cells are numbered along the first ``GRID`` coordinates of a seeded turn.
    """
    dimension = unit.shape[1]
    turn = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))[0]
    place = (unit @ turn)[:, :GRID]
    reach = np.sqrt(max(2 - 2 * least, 0.0)) + 1e-9
    side = max(reach, 2 / 1000)
    steps = int(2 / side) + 3
    own = np.floor((place + 1) / side).astype(np.int64) + 1
    number = lambda c: (c * steps ** np.arange(c.shape[-1])).sum(-1)
    moves = np.array(np.meshgrid(*[[-1, 0, 1]] * place.shape[1])).reshape(place.shape[1], -1).T
    near = own[:, None, :] + moves[None]
    low, high = (near - 1) * side - 1, near * side - 1
    away = np.maximum(np.maximum(low - place[:, None, :], place[:, None, :] - high), 0)
    return number(own), np.where((away**2).sum(2) <= reach**2, number(near), -1)


def _doubles(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, not zero, and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of different lengths as an array of arrays."""
    return column.to_numpy(zero_copy_only=False)


def _members(classes: DataFrame, seed: int, least: float, words: int, exact: bool) -> DataFrame:
    """Each class once for every cap or cell it is in; ``home`` tells its own cell, and is true in caps."""
    schema = classes.select(
        "label", F.lit(0).alias("dimension"), F.lit(0).cast("long").alias("cap"), "node", "n", "vector", F.array(F.lit(0).cast("long")).alias("caps"), F.lit(True).alias("home")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dimension in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == dimension)))
                x = _doubles(part.column("vector")).astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                if exact or dimension < LEAST_DIMENSION:
                    own, caps = cells(x, least, seed)
                else:
                    own, caps = None, ProductCode.of(int(dimension), seed, words).decode(x)
                row, place = np.nonzero(caps >= 0)
                number = caps[row, place]
                home = np.ones(len(row), bool) if own is None else number == own[row]
                sizes = np.bincount(row, minlength=len(caps)) if own is None else np.zeros(len(caps), np.int64)
                kept = number if own is None else number[:0]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(kept))
                for a in range(0, len(row), 4096):
                    at = pa.array(row[a : a + 4096])
                    columns = [part.column("label").take(at), pa.array(np.full(len(at), dimension, np.int32)), pa.array(number[a : a + 4096])]
                    columns += [part.column(c).take(at) for c in ("node", "n", "vector")] + [lists.take(at), pa.array(home[a : a + 4096])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return classes.select("node", "n", "label", "vector").mapInArrow(run, schema)


def _within(group: dict[str, np.ndarray], least: float):
    """Links of a cap: (0, node, number of vectors linked) and (1, node, node) of a spanning forest."""
    node, times, caps = group["node"], group["n"].astype(np.float64), group["caps"]
    n = len(node)
    if n < 2:
        return None
    x = group["vector"].astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    side = group["_side"]
    across = group["_one"][0] != group["_two"][0]
    own, home = group["cap"][0], group["home"]
    # in a cell, a pair meets where the larger node is at home and the smaller one anywhere
    row = np.repeat(np.arange(n), [len(c) for c in caps])
    visits = not len(row)
    flat = np.concatenate(caps) if len(row) else np.zeros(0, np.int64)
    before = flat < own
    numbers, place = np.unique(flat[before], return_inverse=True)
    in_earlier = np.zeros((n, len(numbers)), np.float32)
    in_earlier[row[before], place] = 1
    counts = np.zeros(n)
    forest = Forest(n)
    chunk = max(16, min(512, (1 << 22) // n))
    for a in range(0, n, chunk):
        b = min(n, a + chunk)
        near = x[a:b] @ x.T >= least
        near[np.arange(b - a), np.arange(a, b)] = False
        if across:
            near &= side[a:b, None] != side[None, :]
        if visits:
            later = node[a:b, None] > node[None, :]
            near &= np.where(later, home[a:b, None], home[None, :])
        if not near.any():
            continue
        first = near & (in_earlier[a:b] @ in_earlier.T == 0)
        counts[a:b] = first @ times
        forest.add(near, a, 0)
    if not forest.links:
        return None
    some = np.flatnonzero(counts)
    one, two = np.array(forest.links).T
    kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(one), np.int32)])
    return kinds, np.concatenate([node[some], node[one]]), np.concatenate([counts[some].astype(np.int64), node[two]])


def near_vectors(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, seed: int = 7, exact: bool = False) -> DataFrame:
    """Id, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept`` (whether that is the id) of every row.

    Rows with the same label, not null, and a cosine of at least ``least`` are
    linked.  Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths.  A null id is nobody's component, unless all of its group are null.
    Rows of equal id count each; an empty table gives no rows.  With ``exact`` no link is missed in any dimension, at the
    cost of cells that grow with the number of vectors of a label.
    """
    spark = df.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "caps")
    own = df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    fit = F.col("label").isNotNull() & usable(F.col("vector"))
    classes = own.filter(fit).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = scratch.write(_members(classes, seed, least, words_for(classes.count()), exact), "members")
    keys = ["label", "dimension", "cap"]
    read = {"vector": _doubles, "caps": _lists}
    blocks = in_blocks(members, keys, "node")
    found = over_groups(blocks, [*keys, "_one", "_two"], lambda g: _within(g, least), "kind int, a bigint, b bigint", read)
    found = scratch.write(found, "found")
    scratch.drop("members")
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("more"))
    roots = scratch.write(components(found.filter("kind = 1")), "roots")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").join(links, "node", "left")
    named = named.select("label", "vector", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    linked = own.filter(fit).join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    single = own.filter(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.union(single)
    return scratch.result(every.select(F.col("id").alias(id_), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
