"""Near-duplicate documents by SimHash fingerprints, found with vantage-point trees.

Fingerprints that differ in at most ``bits`` bits agree wholly on one of
``bits + 1`` fields of the fingerprint.  Each field has a vantage-point tree: a
level has a vantage point, and a node's children are the shells of equal Hamming
distance to it.  By the triangle inequality fingerprints that agree on the field
lie in the same shell on every level, so all other branches are pruned and a leaf
is one shard.  Leaves are parted further by the distance of whole fingerprints to
a last vantage point, in shells of ``SHELL``, or of ``bits`` where that is more: a
fingerprint whose distance is within ``bits`` of a shell's lower border is also sent to the shell below, as the
links across that border are looked for there.

Within a shard the exact pairs are found among fingerprints in the order of their
distance to one of them, again cut by the triangle bound, and only the links of a
spanning forest leave it, so a group of thousands of near copies gives as many
rows as it has members.  Large shards are split into blocks that meet in pairs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.llm import jaccard
from leafpress.llm.common import Scratch, arrow_ready, slices
from leafpress.llm.components import components
from leafpress.llm.grouped import Forest, in_blocks, over_groups

#: Words in a shingle, seed of its hash.
WORDS = 4
SEED = 42
#: Levels of a tree, and the least width of the last shells.
LEVELS = 10
SHELL = 8
#: Hashes whose bits are added at once.
TOGETHER = 1 << 17


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of the word shingles, repeats included; 0 for a text without words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    stops = (ends[-n:] - 1).tolist()
    starts = [0, *ends[: n - 1].tolist()]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, TOGETHER):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + TOGETHER], stops[at : at + TOGETHER])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str, keep: list[str], words: int = WORDS) -> DataFrame:
    """The kept columns and ``print``, the fingerprint as a signed 64-bit integer (null text: as an empty one)."""
    arrow_ready(df.sparkSession)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            prints = np.array([fingerprint(t or "", words) for t in part.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(prints)], names=[*keep, "print"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(prints: DataFrame, bits: int, seed: int = 7) -> DataFrame:
    """Rows (tree, leaf, shell, print): each fingerprint in the shards of every tree in which its links are looked for."""
    rng = random.Random(seed)
    fields = bits + 1
    edges = [64 * i // fields for i in range(fields + 1)]

    def far(field: Column, point: int) -> Column:
        return F.bit_count(field.bitwiseXOR(F.lit(_signed(point))))

    trees = []
    for t, (a, b) in enumerate(zip(edges, edges[1:])):
        mask = ((1 << (b - a)) - 1) << a
        field = F.col("print").bitwiseAND(F.lit(_signed(mask)))
        path = F.lit(0).cast("long")
        for level in range(LEVELS):
            # a field has up to 64 / 2 bits, so a distance takes 6 bits of the path
            path = path.bitwiseXOR(F.shiftleft(far(field, rng.getrandbits(64) & mask).cast("long"), 6 * level))
        trees.append(F.struct(F.lit(t).alias("tree"), path.alias("leaf")))
    distance = far(F.col("print"), rng.getrandbits(64))
    width = max(SHELL, bits)  # a link crosses one border at most
    own = F.floor(distance / width).cast("int")
    shells = F.when((distance % width < bits) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = prints.select("print", F.explode(F.array(*trees)).alias("t"), shells.alias("shells"))
    return spread.select("t.tree", "t.leaf", F.explode("shells").alias("shell"), "print")


def forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Links that span the groups of distinct fingerprints (unsigned) within ``bits`` of each other, through one another."""
    n = len(prints)
    if n < 2:
        return None
    distance = np.bitwise_count(prints ^ prints[0]).astype(np.int64)
    order = np.argsort(distance, kind="stable")
    x, d = prints[order], distance[order]
    found = Forest(n)
    chunk = max(16, min(512, (1 << 21) // n))
    for a in range(0, n, chunk):
        b = min(n, a + chunk)
        stop = int(np.searchsorted(d, d[b - 1] + bits, side="right"))
        near = np.bitwise_count(x[a:b, None] ^ x[None, a:stop]) <= bits
        rows = np.arange(b - a)
        near[rows, rows] = False
        if near.any():
            found.add(near, a, a)
    if not found.links:
        return None
    one, two = np.array(found.links).T
    return x[one], x[two]


def near_prints(scratch: Scratch, prints: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that span the groups of a table of distinct ``print`` within ``bits`` of each other."""
    placed = scratch.write(shards(prints, bits), "shards")
    blocks = in_blocks(placed, ["tree", "leaf", "shell"], "print").drop("_side")

    def links(group: dict[str, np.ndarray]):
        found = forest(group["print"].view(np.uint64), bits)
        return None if found is None else tuple(c.view(np.int64) for c in found)

    return over_groups(blocks, ["tree", "leaf", "shell", "_one", "_two"], links, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", bits: int = 4, words: int = WORDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """Id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links) of every row of ``df``.

    Documents whose fingerprints differ in at most ``bits`` bits are linked.  Null
    and empty texts have the fingerprint zero and are linked like any other; rows
    of equal id are rows of their own; a null id is nobody's smallest, unless all
    of its group are null.  ``extra`` adds columns of ``df`` to the result.
    """
    if not 0 <= bits < 32:
        raise ValueError("bits must be from 0 to 31")
    scratch = Scratch(df.sparkSession, "simhash")
    extra = extra or {}
    own = df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").alias("text"), *[c.alias(n) for n, c in extra.items()])
    rows = scratch.write(fingerprints(own, "text", ["id", *extra], words), "rows")
    prints = scratch.write(rows.groupBy("print").agg(F.min("id").alias("first")), "prints")
    found = near_prints(scratch, prints, bits)
    roots = scratch.write(components(found), "roots")
    scratch.drop("shards")
    named = prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = scratch.write(named.select("print", "root").join(smallest, "root").select("print", "component_id"), "groups")
    result = rows.join(groups, "print").select(
        F.col("id").alias(id_), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", *extra
    )
    return scratch.result(result)


def keep_one(
    df: DataFrame, id_: str = "doc_id", text: str = "text", bits: int = 4, words: int = WORDS, similarity: float | None = None,
) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (a null id last), with all columns of ``df``.

    With ``similarity``, near duplicates are those of shingles with that Jaccard
    similarity or more: fingerprints within ``bits`` propose them by the same trees, MinHash
    bands those beyond that radius, and exact similarities decide (``jaccard``).  Of rows with
    equal id and text one stays.
    """
    if not 0 <= bits < 32:
        raise ValueError("bits must be from 0 to 31")
    if similarity is None:
        found = near_duplicates(df.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", bits, words, {"_digest": jaccard.digest("text")})
        groups = ["component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_print")]
    else:
        found = jaccard.near_duplicates(df, id_, text, words, similarity, partial(near_prints, bits=bits)).withColumnRenamed("digest", "_digest")
        groups = ["root"]
    best = found.groupBy(*groups).agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), "_digest")).alias("best"))
    kept = best.select(F.col("best.id").alias("kept_id"), F.col("best._digest").alias("kept_digest")).checkpoint(eager=True)
    # columns go by number, so none of the caller's can clash with ours
    own = [f"c{i}" for i in range(len(df.columns))]
    at = own[df.columns.index(id_)]
    rows = df.toDF(*own).withColumn("digest", jaccard.digest(own[df.columns.index(text)]))
    rows = rows.join(kept, F.col(at).eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    first = F.row_number().over(Window.partitionBy(at, "digest").orderBy("digest"))
    return rows.withColumn("nth", first).filter("nth = 1").select(*own).toDF(*df.columns)
