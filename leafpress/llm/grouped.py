"""Groups of rows as arrays, split where they are large.

A group whose rows must all meet is cut into blocks of ``block`` rows by a hash;
each pair of blocks is a group of its own, so a row goes to as many groups as
there are blocks.  Only large groups are looked up, and there are few of them: a
group counts as large from a ``share`` of all rows on, at least from
``LEAST_BLOCK`` rows, so their list has at most 1 / share rows and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK = 8192
SHARE = 1e-5


def in_blocks(rows: DataFrame, keys: list[str], by: str, least: int = LEAST_BLOCK) -> DataFrame:
    """Add ``_one``, ``_two`` (the blocks that meet, _one <= _two) and ``_side`` (the row's own block).

    ``rows`` is read twice, so it should be a written table.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    block = max(least, int(total * SHARE) + 1)
    large = counts.filter(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    marked = rows.join(F.broadcast(large), keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(11), by), F.col("_blocks")).cast("int")
    marked = marked.withColumn("_side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return marked.withColumn("_one", F.least("_side", "_other")).withColumn("_two", F.greatest("_side", "_other")).drop("_blocks", "_other")


def over_groups(
    rows: DataFrame, keys: list[str], f: Callable[..., tuple[np.ndarray, ...] | None], schema: str,
    read: dict[str, Callable[[pa.Array], np.ndarray]] | None = None,
) -> DataFrame:
    """Apply ``f`` to the columns (name to array) of each group of rows with equal keys, none of them null.

    ``f`` gives the columns of its result, or None.  Many small groups share a
    task, its batches and its output; ``read`` says how a group's part of a column becomes an array.
    """
    names = [part.split()[0] for part in schema.split(",")]
    columns = rows.columns
    read = read or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        made: list[tuple[np.ndarray, ...]] = []
        last, size = None, 0

        def close() -> None:
            nonlocal size
            out = f(held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in columns})
            held.clear()
            if out is not None:
                made.append(out)
                size += len(out[0])

        def flush() -> pa.RecordBatch:
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=names)
            made.clear()
            size = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: batch.column(c) if c in read else batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            changed = np.zeros(batch.num_rows, bool)
            for k in keys:
                changed[1:] |= own[k][1:] != own[k][:-1]
            edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            goes_on = last is not None and all(own[k][0] == v for k, v in zip(keys, last))
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                if held and (i or not goes_on):
                    close()
                held.append({c: read[c](v.slice(a, b - a)) if c in read else v[a:b] for c, v in own.items()})
            last = [own[k][-1] for k in keys]
            if size > 50_000:
                yield flush()
        if held:
            close()
        if made:
            yield flush()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


class Forest:
    """Gathers links that span the groups of ``n`` things, from parts of the table of who is near whom."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def _top(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, near: np.ndarray, a: int, first: int) -> None:
        """``near`` has the things from ``a`` on as rows and those from ``first`` <= a on, the rows among them, as columns.

        The smallest label spreads over rows and columns until it is still, so a
        dense part gives a link for each thing and not for each pair.
        """
        rows, columns = near.shape
        own = slice(a - first, a - first + rows)
        used = near.any(0)
        used[own] |= near.any(1)
        place = np.flatnonzero(used)
        if not len(place):
            return
        part, labels = near[:, place], np.arange(columns)
        while True:
            new = labels.copy()
            new[place] = np.minimum(new[place], np.where(part, labels[own, None], columns).min(0))
            new[own] = np.minimum(new[own], np.where(part, new[None, place], columns).min(1))
            if np.array_equal(new, labels):
                break
            labels = new
        for i, label in zip(place.tolist(), labels[place].tolist()):
            p, q = self._top(first + i), self._top(first + label)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.links.append((first + label, first + i))
