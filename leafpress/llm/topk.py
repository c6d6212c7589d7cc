"""Exact top-k search by inner product, over segment statistics from coarse to fine.

For a segment of m components, vectors with means a, b and deviations s, t are at
least m (a - b)^2 + m (s - t)^2 apart (squared), so their inner product over it is
at most m (a b + s t).  One segment gives the coarsest bound, more segments finer
ones.  Queries meet rows in pairs of blocks; in each, the rows that look best by
the finest bound give a first k-th best score, bounds rule out rows level by
level, and only the survivors' inner products are computed, in integers.  The best
of each pair of blocks are ranked for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch, arrow_ready
from leafpress.llm.grouped import over_groups

#: Segments of each level.
LEVELS = (1, 4, 16)
#: Queries and rows in a block.
QUERY_BLOCK = 2048
ROW_BLOCK = 4096
#: Integers up to this have inner products that a double holds, for up to 2^12 components.
SAFE = 1 << 20


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their lengths: products of two rows bound inner products."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    squares = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
    deviations = np.sqrt(np.maximum(squares - means * means, 0))
    return np.hstack([means, deviations]) * np.sqrt(np.tile(lengths, 2))


def best(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """For each query: places and scores of its best rows, without the row ``own`` (-1: none); ties to smaller ids."""
    levels = [(statistics(queries, s), statistics(rows, s)) for s in LEVELS]
    fine = levels[-1]
    exact = rows.astype(np.int64)
    for i, q in enumerate(queries.astype(np.int64)):
        seen = np.arange(len(rows)) if own[i] < 0 else np.delete(np.arange(len(rows)), own[i])
        if len(seen) > 4 * k:
            bound = fine[1][seen] @ fine[0][i]
            first = seen[np.argpartition(-bound, 2 * k)[: 2 * k]]
            level = np.sort(exact[first] @ q)[-k]
            for theirs in levels:
                bound = theirs[1][seen] @ theirs[0][i]
                # room for what doubles lose
                seen = seen[bound >= level - 1 - 1e-9 * np.abs(bound)]
        score = exact[seen] @ q
        order = np.lexsort((ids[seen], -score))[:k]
        yield i, seen[order], score[order]


def _large(queries: list[list[int]], rows: list[list[int]], own: np.ndarray, ids: np.ndarray, k: int):
    """As ``best``, for integers of any size; scores beyond 64 bits end at its borders."""
    for i, q in enumerate(queries):
        scored = sorted((-sum(a * b for a, b in zip(q, r)), int(ids[j]), j) for j, r in enumerate(rows) if j != own[i])[:k]
        yield i, np.array([j for _, _, j in scored], np.int64), np.array([max(-(2**63), min(2**63 - 1, -s)) for s, _, _ in scored], np.int64)


def top_k(df: DataFrame, query: Column, id_: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of the highest scores for each row of ``df`` that fits ``query``: ``query_id``, ``rank``, id and ``score``.

    A score is the inner product of floor(scale * component) of both vectors.  A
    query meets all rows but itself; ties go to the smaller id.  Vectors that are null
    or hold null or non-finite components take no part, nor do rows with a null id;
    vectors of different lengths do not meet.  Each row with a repeated id is a row, and a query, of its own.
    """
    spark = df.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "topk")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.withColumn("_query", query).select(F.col(f"`{id_}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col("_query").alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0)).filter(~bad)
    # a long cannot hold the floor of a large double; such components are whole anyway
    scaled = F.transform("vector", lambda x: x.cast("double") * scale)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    rows = rows.select("id", whole.alias("vector"), F.size("vector").alias("dimension"), F.coalesce("asks", F.lit(False)).alias("asks"))
    rows = scratch.write(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    n, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    query_blocks, row_blocks = max(1, -(-asked // QUERY_BLOCK)), max(1, -(-n // ROW_BLOCK))
    placed = rows.withColumn("_of", F.xxhash64("node"))
    questions = placed.filter("asks").select(
        "dimension", F.pmod("_of", F.lit(query_blocks)).cast("int").alias("_q"),
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("_r"), F.lit(1).alias("asks"), "node", "id", "vector",
    )
    answers = placed.select(
        "dimension", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_q"),
        F.pmod("_of", F.lit(row_blocks)).cast("int").alias("_r"), F.lit(0).alias("asks"), "node", "id", "vector",
    )

    def meet(group: dict[str, np.ndarray]):
        asks = group["asks"] == 1
        if asks.all() or not asks.any():
            return None
        queries, others = group["vector"][asks], group["vector"][~asks]
        place = {node: i for i, node in enumerate(group["node"][~asks].tolist())}
        own = np.array([place.get(node, -1) for node in group["node"][asks].tolist()])
        ids = group["id"][~asks]
        if max(np.abs(queries).max(), np.abs(others).max()) <= SAFE and queries.shape[1] <= 1 << 12:
            found = best(queries, others, own, ids, k)
        else:
            found = _large([[int(v) for v in q] for q in queries], [[int(v) for v in r] for r in others], own, ids, k)
        asker, asker_id = group["node"][asks], group["id"][asks]
        parts = [(np.full(len(at), asker[i]), np.full(len(at), asker_id[i]), ids[at], score) for i, at, score in found]
        return tuple(np.concatenate(c) for c in zip(*parts))

    kind = df.schema[id_].dataType.simpleString()
    read = {"vector": lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)}
    schema = f"asker bigint, query_id {kind}, id {kind}, score bigint"
    found = over_groups(questions.union(answers), ["dimension", "_q", "_r"], meet, schema, read)
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return scratch.result(ranked.select("query_id", "rank", F.col("id").alias(id_), "score"))
