"""A Merkle manifest of a table: a tree of hashes for each language, one over their roots, and a proof for each row.

A leaf is the hash of a row's fields.  Leaves of a language are numbered by id; the
numbers are cut into leaf partitions of ``SPAN``, and a partition hashes its own
subtree.  The roots of partitions are leaves of the next round, so a tree of 10^11 rows takes
four rounds, and no task sees more than ``SPAN`` nodes of a partition.

Proofs are an octopus: a partition lists the coordinates that are missing for all
its leaves together (``missing``), each once, fetches these nodes in one join, builds
the interiors that its leaves share, and reads the proof of every leaf from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch, arrow_ready
from leafpress.operators.skew import ranked

#: Levels of a leaf partition, and its leaves.
LEVELS = 12
SPAN = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: bytes) -> bytes:
    """SHA-256 of hex texts, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field_text(value: Column) -> Column:
    """A field of a leaf: ``-`` for null, else the size of its UTF-8 text, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(n - 1, 0).bit_length()


def missing(leaves: set[int], n: int) -> list[tuple[int, int]]:
    """Coordinates (level, place) of the fewest nodes that, with these leaves, give the root of a tree of ``n`` leaves."""
    out, known = [], set(leaves)
    for level in range(height(n)):
        size = -(-n // (1 << level))
        out += [(level, i ^ 1) for i in sorted(known) if i ^ 1 < size and i ^ 1 not in known]
        known = {i >> 1 for i in known}
    return out


def subtree(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """Nodes over consecutive leaves, ``levels`` levels up; a node without a second one is hashed alone."""
    out = [leaves]
    for _ in range(levels):
        row = out[-1]
        out.append([_hash(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of sorted batches, by equal keys; a group is a leaf partition and has at most a few thousand rows."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_group(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], f: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for group in _groups(batches, keys):
            made += f(group)
            if len(made) >= 8192:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in made], kinds)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in made], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def grow(leaves: DataFrame, scratch: Scratch, tag: str) -> tuple[DataFrame, DataFrame]:
    """Trees ``k`` over leaves (k, i, node), numbered from 0 on: nodes from the roots of partitions up (k, level, i, node), and roots (k, n, root)."""
    counts = scratch.write(leaves.groupBy("k").agg(F.count(F.lit(1)).alias("n")), f"{tag}_counts")
    most = counts.agg(F.max("n")).first()[0] or 0

    def partition(group: list[dict]) -> list[tuple]:
        row = group[0]
        own = subtree([r["node"].encode() for r in group], height(len(group)))[-1][0]
        raised = own
        for _ in range(LEVELS - height(len(group))):
            raised = _hash(raised)
        return [(row["k"], row["part"], own.decode(), raised.decode())]

    parted = leaves.select("k", F.shiftright("i", LEVELS).alias("part"), "i", "node")
    roots = _by_group(parted, ("k", "part"), ("i",), partition, "k string, part long, own string, raised string")
    roots = scratch.write(roots.join(counts, "k"), f"{tag}_parts")
    done = roots.filter(F.col("n") <= SPAN).select("k", "n", F.col("own").alias("root"))
    level, nodes = LEVELS, []
    above = roots.filter(F.col("n") > SPAN).select("k", "n", F.col("part").alias("i"), F.col("raised").alias("node"))

    def climb(group: list[dict]) -> list[tuple]:
        row = group[0]
        levels = min(LEVELS, height(row["n"]) - level)
        rows = subtree([r["node"].encode() for r in group], levels)
        first = row["i"]
        return [(row["k"], row["n"], level + d, (first >> d) + j, x.decode()) for d, own in enumerate(rows) for j, x in enumerate(own)]

    while (most - 1) >> level > 0:
        parted = above.select("k", "n", F.shiftright("i", LEVELS).alias("part"), "i", "node")
        step = scratch.write(_by_group(parted, ("k", "part"), ("i",), climb, "k string, n long, level int, i long, node string"), f"{tag}_{level}")
        ends = F.col("level") == F.length(F.bin(F.col("n") - 1))
        done = done.union(step.filter(ends).select("k", "n", F.col("node").alias("root")))
        level += LEVELS
        above = step.filter((F.col("level") == level) & ~ends).select("k", "n", "i", "node")
        nodes.append(step.filter(F.col("level") < level).select("k", "level", "i", "node"))
    none = scratch.spark.createDataFrame([], "k string, level int, i long, node string")
    for n in nodes:
        none = none.union(n)
    return none, done


def _wanted(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each leaf partition (k, part, n), the nodes that its leaves miss together, fetched once: k, part, level, i, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first = r["part"] * SPAN
                own = missing(set(range(first, min(first + SPAN, r["n"]))), r["n"])
                out += [{"k": r["k"], "part": r["part"], "level": level, "i": i} for level, i in own]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k", pa.string()), ("part", pa.int64()), ("level", pa.int32()), ("i", pa.int64())]))

    asked = parts.select("k", "part", "n").mapInArrow(run, "k string, part long, level int, i long")
    return asked.join(nodes, ["k", "level", "i"])


def fold(leaf: bytes, i: int, n: int, siblings: Iterator[bytes]) -> bytes:
    """The root that a leaf at place ``i`` of ``n`` gives with the siblings of its proof."""
    for level in range(height(n)):
        place = i >> level
        if place & 1:
            leaf = _hash(next(siblings), leaf)
        elif place + 1 < -(-n // (1 << level)):
            leaf = _hash(leaf, next(siblings))
        else:
            leaf = _hash(leaf)
    return leaf


def proofs(leaves: DataFrame, nodes: DataFrame, roots: DataFrame, f: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply ``f`` to every leaf: its row, its place, the size of its tree, its siblings from the bottom up, and the tree's row of ``roots``.

    ``leaves`` has k, i, node, id and other (a second leaf, or null), ``roots`` k, n, root and
    ``path``, an array that is handed on.
    """
    parts = leaves.select("k", F.shiftright("i", LEVELS).alias("part")).distinct().join(roots, "k")
    empty = {c: F.lit(None).cast(t) for c, t in leaves.dtypes}
    fetched = _wanted(parts, nodes).select(
        "k", "part", F.lit(1).alias("kind"), "i", F.col("level"), "node", *[v.alias(c) for c, v in empty.items() if c not in ("k", "i", "node")],
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("path"),
    )
    heads = parts.select(
        "k", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("i"), F.lit(0).alias("level"), F.col("root").alias("node"),
        *[v.alias(c) for c, v in empty.items() if c not in ("k", "i", "node")], "n", "path",
    )
    own = leaves.select(
        "k", F.shiftright("i", LEVELS).alias("part"), F.lit(2).alias("kind"), "i", F.lit(0).alias("level"), "node",
        *[c for c in leaves.columns if c not in ("k", "i", "node")], F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<string>").alias("path"),
    )

    def expand(group: list[dict]) -> list[tuple]:
        head = group[0]
        above = {(r["level"], r["i"]): r["node"].encode() for r in group if r["kind"] == 1}
        rows = [r for r in group if r["kind"] == 2]
        n, first = head["n"], rows[0]["i"]
        levels = height(n)
        inside = subtree([r["node"].encode() for r in rows], min(levels, LEVELS))
        out = []
        for r in rows:
            i, siblings = r["i"], []
            for level in range(levels):
                other = (i >> level) ^ 1
                if level < LEVELS:
                    place = other - (first >> level)
                    if 0 <= place < len(inside[level]):
                        siblings.append(inside[level][place])
                        continue
                if (level, other) in above:
                    siblings.append(above[level, other])
            out.append(f(r, i, n, siblings, head))
        return out

    return _by_group(own.unionByName(heads).unionByName(fetched), ("k", "part"), ("kind", "i"), expand, schema)


def manifest(df: DataFrame, id_: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, changed: Column | None = None, change: tuple[str, Column] | None = None) -> DataFrame:
    """For each row of ``df``: id, ``leaf``, ``subroot`` (of its group), ``root``, ``proof_sha256`` (hash of its
    siblings), ``folded_root`` (from its leaf and its siblings) and ``verified``.

    ``changed`` tells the rows of which the leaf is folded with the column ``change[0]`` replaced by ``change[1]``,
    all else is of the rows as they are.  Groups are ordered by UTF-8 bytes, null first.  In a group,
    a null id comes first; rows of equal id are ordered by their leaves, so equal rows are alike
    whatever their order.  An empty table gives no rows.
    """
    spark = df.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "manifest")
    quoted = {c: F.col(f"`{c}`") for c in fields}
    leaf = F.sha2(F.concat(*[field_text(quoted[c]) for c in fields]), 256)
    other = F.lit(None).cast("string")
    if changed is not None:
        other = F.when(changed, F.sha2(F.concat(*[field_text(change[1] if c == change[0] else quoted[c]) for c in fields]), 256))
    key = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    rows = scratch.write(df.select(key.alias("k"), F.col(f"`{id_}`").alias("id"), leaf.alias("node"), other.alias("other")), "rows")
    numbered = ranked(rows, ["k"], ["id", "node"], "i").withColumn("i", F.col("i") - 1)
    leaves = scratch.write(numbered.select("k", "i", "id", "node", "other"), "leaves")
    scratch.drop("rows")
    nodes, roots = grow(leaves.select("k", "i", "node"), scratch, "group")
    roots = scratch.write(roots, "group_roots")

    # the tree over the groups: their proofs are handed to the partitions
    tops = scratch.write(ranked(roots.select(F.col("k").alias("id"), F.col("root").alias("node")), [], ["id"], "i").select(
        F.lit("").alias("k"), (F.col("i") - 1).alias("i"), "id", "node"), "tops")
    top_nodes, top_root = grow(tops.select("k", "i", "node"), scratch, "all")
    top_root = scratch.write(top_root.withColumn("path", F.array().cast("array<string>")), "all_roots")

    def group_path(r: dict, i: int, n: int, siblings: list[bytes], head: dict) -> tuple:
        return r["id"], i, n, [x.decode() for x in siblings], head["node"]

    paths = scratch.write(proofs(tops, top_nodes, top_root, group_path, "k string, at long, groups long, siblings array<string>, top string"), "paths")
    # root, place, number of groups and siblings of a group, in one array
    packed = F.concat(F.array("top", F.col("at").cast("string"), F.col("groups").cast("string")), "siblings").alias("path")
    roots = scratch.write(roots.join(paths.select("k", packed), "k"), "group_paths")

    def row_proof(r: dict, i: int, n: int, siblings: list[bytes], head: dict) -> tuple:
        top, at, groups, *above = head["path"]
        above = [x.encode() for x in above]
        folded = fold((r["other"] or r["node"]).encode(), i, n, iter(siblings))
        folded = fold(folded, int(at), int(groups), iter(above)).decode()
        return r["id"], r["node"], head["node"], top, _hash(*siblings, *above).decode(), folded, folded == top

    kind = dict(leaves.dtypes)["id"]
    schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = proofs(leaves, nodes, roots, row_proof, schema)
    return scratch.result(done.withColumnRenamed("id", id_))
