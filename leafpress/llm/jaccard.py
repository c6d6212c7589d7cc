"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Candidates come from two sides.  Documents whose SimHash prints are near each other
are found by the caller (``simhash.near_prints``, vantage-point trees).  A radius of
64-bit prints that reaches all pairs of similarity 0.8 is so wide
that no field of the print parts unrelated documents, so pairs beyond the radius
come from MinHash bands: documents whose sets have the least hash values of one band in
common are linked to the least of them.  The groups that both kinds of links span are
verified.  A pair of similarity s meets in a band with probability
1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8, more above; below, the verification
decides.  Every document of a group moves once, and the exact similarities are
looked at there, through the rarest shingles that a pair has to share; large
groups are split into blocks that meet in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.llm.common import Scratch, arrow_ready, slices
from leafpress.llm.components import components
from leafpress.llm.grouped import in_blocks, over_groups

#: Words in a shingle, seed of its hash, least similarity of a link.
WORDS = 5
SEED = 42
SIMILARITY = 0.8
#: Bands and the hash functions of each.
BANDS = 40
ROWS = 7
#: Shingles that are hashed at once, and documents in a block of a large group.
TOGETHER = 1 << 11
BLOCK = 2048
#: Hashes whose bits are added at once.
ADDED = 1 << 17
#: Sets in candidate groups up to which their list is broadcast and other texts are not moved.
FEW = 200_000

_rng = np.random.default_rng(SEED)
_TIMES = (_rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)[:, None]


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    stops = (ends[-n:] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(hashes(text, words))


def majority(every: np.ndarray) -> int:
    """The SimHash print of the hashes: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(every), ADDED):
        ones += np.unpackbits(every[a : a + ADDED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(every)).tobytes(), "big")


def bands(own: np.ndarray) -> list[int]:
    """A signed 64-bit value for each band of a set of shingles, none for the empty set."""
    import xxhash

    if not len(own):
        return []
    x = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), TOGETHER):
        np.minimum(least, (x[None, a : a + TOGETHER] * _TIMES + _PLUS).min(1), out=least)
    data, size = least.tobytes(), 4 * ROWS
    made = [xxhash.xxh64_intdigest(data[size * b : size * (b + 1)], b) for b in range(BANDS)]
    return np.array(made, np.uint64).view(np.int64).tolist()


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that span the groups of sets (sorted, distinct, not empty) with a Jaccard similarity of ``least`` or more.

    A set has to share one of its rarest members with any set that is near it and
    no larger.  Only sets that are not yet in one group are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    of = np.repeat(np.arange(len(order)), sizes)
    _, member, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    by = np.argsort(member, kind="stable")
    holders, first = of[by], np.concatenate([[0], np.cumsum(count)])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    labels, links = np.arange(len(order)), []

    def near(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
        return both >= least * (sizes[i] + sizes[j] - both) - 1e-9

    for i in range(1, len(order)):
        own = member[edges[i] : edges[i + 1]]
        own = own[np.argsort(count[own], kind="stable")]
        n = len(own)
        rarest = own[: n - math.ceil(least * n - 1e-9) + 1]
        rarest = rarest[count[rarest] > 1]
        if not len(rarest):
            continue
        low = int(np.searchsorted(sizes, least * n - 1e-9))
        found = np.concatenate([holders[first[m] : first[m + 1]] for m in rarest.tolist()])
        found = np.unique(found[(found >= low) & (found < i)])
        while len(found := found[labels[found] != labels[i]]):
            j = int(found[0])
            if near(i, j):
                links.append((order[j], order[i]))
                labels[labels == labels[j]] = labels[i]
            found = found[1:]
    return links


def _sketches(df: DataFrame, keep: list[str], words: int) -> DataFrame:
    """The kept columns, ``key`` (a hash of the set of shingles), ``print`` (of all shingles, signed) and ``bands``."""
    made = [T.StructField("key", T.LongType()), T.StructField("print", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType([*[df.schema[c] for c in keep], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, "text"):
            every = [hashes(t or "", words) for t in part.column("text").to_pylist()]
            prints = np.array([majority(h) for h in every], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in every]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            columns = [*(part.column(c) for c in keep), pa.array(keys), pa.array(prints), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def _band_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) from each set to the least one that has a band in common with it."""
    placed = sets.select(F.explode("bands").alias("band"), "key")
    met = placed.groupBy("band").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return placed.join(met, "band").filter("key > low").select(F.col("key").alias("a"), F.col("low").alias("b"))


def _print_links(rows: DataFrame, near_prints: Callable[[Scratch, DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """Links (a, b) from each set to the least one of its print, and between these where their prints are near."""
    owners = rows.filter(F.size("bands") > 0).select("print", "key").distinct()
    prints = scratch.write(owners.groupBy("print").agg(F.min("key").alias("low")), "prints")
    same = owners.join(prints, "print").filter("key > low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    near = near_prints(scratch, prints.select("print"))
    near = near.join(prints.toDF("a", "one"), "a").join(prints.toDF("b", "two"), "b")
    return same.union(near.select("one", "two"))


def near_duplicates(
    df: DataFrame, id_: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    near_prints: Callable[[Scratch, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``id``, ``digest`` (of the text) and ``root`` (the group) of every row of ``df``.

    Documents whose sets of shingles have a Jaccard similarity of ``similarity`` or
    more are linked, and a group is what links reach.  Null texts and texts without
    words are one group.  ``near_prints`` gives the links (a, b) of a table of
    distinct prints; what they link is verified like what meets in a band.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError("the bands are made for similarities from 0.8 to 1")
    arrow_ready(df.sparkSession)
    scratch = Scratch(df.sparkSession, "jaccard")
    own = df.select(F.col(f"`{id_}`").alias("id"), digest(text).alias("digest"), F.col(f"`{text}`").alias("text"))
    rows = scratch.write(_sketches(own, ["id", "digest"], words), "rows")
    sets = rows.groupBy("key").agg(F.first("bands").alias("bands"), F.min(F.struct("id", "digest")).alias("one"))
    sets = scratch.write(sets.select("key", "bands", "one.id", "one.digest"), "sets")
    links = _band_links(sets)
    if near_prints is not None:
        links = _print_links(rows, near_prints, scratch).union(links)
    asked = scratch.write(components(links).withColumnRenamed("node", "key").join(sets.select("key", "id", "digest"), "key"), "asked")
    if asked.count() <= FEW:
        asked = F.broadcast(asked)
    same = own["id"].eqNullSafe(asked["id"]) & (own["digest"] == asked["digest"])
    texts = scratch.write(own.join(asked, same).select("root", "key", "text").dropDuplicates(["root", "key"]), "texts")
    blocks = in_blocks(texts, ["root"], "key", BLOCK).drop("_side")

    def verified(group: dict[str, np.ndarray]):
        found = similar([shingles(t, words) for t in group["text"]], similarity)
        if not found:
            return None
        a, b = np.array(found).T
        return group["key"][a], group["key"][b]

    near = over_groups(blocks, ["root", "_one", "_two"], verified, "a bigint, b bigint")
    roots = scratch.write(components(near).withColumnRenamed("node", "key"), "roots")
    result = rows.select("id", "digest", "key").join(roots, "key", "left").select("id", "digest", F.coalesce("root", "key").alias("root"))
    return scratch.result(result)


def digest(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`"), F.col(f"`{text}`").isNull())
