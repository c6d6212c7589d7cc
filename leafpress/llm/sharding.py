"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``cells`` equal cells; a row's key hashes to a cell, and each shard
has ``vnodes`` virtual nodes at seeded cells.  A cell belongs to the next virtual
node clockwise, its arc.  No shard takes more than its bound: a shard keeps the
rows of its own arcs up to the bound, in ring order, and the rows beyond it go on
clockwise, arc by arc, to the next shard that has room.  So only the overflow
leaves its home shard.

Which row goes where follows from counts per cell, a table bounded by the ring
and not by the data.  Rows move as ids and carried columns only: once to count equal
ones, after which they are written, and once to be numbered within their cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch

#: Rows with equal keys and columns are counted before they move and made again in pieces of this many.
PIECE = 1 << 16


def _cell(cells: int, seed: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(cells)).cast("int")


def ring_nodes(spark: SparkSession, shards: int, vnodes: int, cells: int, seed: int) -> DataFrame:
    """Virtual nodes: arc (their number on the ring), cell, shard and the shards met clockwise from there."""
    nodes = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("shard"), (F.col("id") / shards).cast("int").alias("node"))
        .select("shard", _cell(cells, seed, F.lit("node"), F.col("shard"), F.col("node")).alias("cell"))
        .groupBy("cell").agg(F.min("shard").alias("shard"))
    )
    ring = Window.orderBy("cell")
    # counterclockwise from the end: a running minimum, where a frame up to the end is summed anew for each row
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = []
    for s in range(shards):
        at = F.when(F.col("shard") == s, F.col("cell"))
        # a shard whose nodes all fell on taken cells comes last
        far = F.coalesce(F.min(at).over(ahead), F.min(at).over(around) + cells, F.lit(2 * cells))
        met.append(F.struct(far.alias("far"), F.lit(s).alias("s")))
    return nodes.select(
        (F.row_number().over(ring) - 1).alias("arc"), "cell", "shard",
        F.transform(F.array_sort(F.array(*met)), lambda x: x["s"]).alias("met"),
    )


def _overflow(arcs: DataFrame, room: DataFrame) -> DataFrame:
    """Take the overflow of the arcs (arc, left, met) in ring order to the next shards with room.

    A fold over at most one entry for each virtual node, and the shards that each meets.
    """
    walk = """aggregate(
        arcs,
        named_struct('room', room, 'out', cast(array() as array<struct<arc:int,shard:int,take:bigint>>)),
        (acc, a) -> aggregate(
            a.met,
            named_struct('left', a.left, 'room', acc.room, 'out', acc.out),
            (st, s) -> named_struct(
                'left', st.left - least(st.left, st.room[s]),
                'room', transform(st.room, (r, i) -> if(i = s, r - least(st.left, r), r)),
                'out', if(least(st.left, st.room[s]) > 0,
                          concat(st.out, array(named_struct('arc', a.arc, 'shard', s, 'take', least(st.left, st.room[s])))),
                          st.out)),
            st -> named_struct('room', st.room, 'out', st.out)),
        acc -> acc.out)"""
    entries = arcs.select(F.struct("arc", "left", "met").alias("a"), F.lit(None).cast("array<bigint>").alias("room"))
    entries = entries.unionByName(room.select(F.lit(None).cast(entries.schema["a"].dataType).alias("a"), "room"))
    one = entries.agg(F.sort_array(F.collect_list("a")).alias("arcs"), F.first("room", True).alias("room"))
    return one.select(F.posexplode(F.expr(walk)).alias("step", "t")).select("step", "t.arc", "t.shard", "t.take")


def ring_shards(
    df: DataFrame, key: str, shards: int, *, vnodes: int = 64, cells: int = 1 << 14, slack: float = 0.0, seed: int = 7
) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to the narrow rows of ``df``.

    With ``slack`` 0 the bounds add up to the number of rows, so counts are at
    most one apart; a greater one lets a shard hold (1 + slack) times the mean
    and moves fewer rows when a shard is added.  Rows of equal key go to one
    cell, and stay together unless a bound falls between them.  Null keys are a
    key like any other, equal rows are told apart by number only, an empty table
    gives an empty result.  Columns named ``shard`` or ``slot`` are replaced.

    Bounds: the tables of cells, arcs and moves have at most ``cells``,
    ``shards * vnodes`` and ``shards * (shards * vnodes + 1)`` rows, whatever
    the data; these alone are broadcast or folded in one task.
    """
    if shards < 1 or vnodes < 1 or cells < shards * vnodes or slack < 0:
        raise ValueError("there must be a shard, a node for each, a cell for each node, and no negative slack")
    spark = df.sparkSession
    scratch = Scratch(spark, "ring")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    own = [f"_c{i}" for i in range(len(kept))]
    counted = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own)]).groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    at = own[kept.index(key)]
    rows = scratch.write(counted.withColumn("_cell", _cell(cells, seed, F.lit("key"), F.col(at))), "rows")

    nodes = scratch.write(ring_nodes(spark, shards, vnodes, cells, seed), "nodes")
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = rows.groupBy(F.col("_cell").alias("cell")).agg(F.sum("_n").alias("n"))
    # each cell belongs to the first node at it or after it, the last cells to the first node
    every = (
        spark.range(cells).select(F.col("id").cast("int").alias("cell"))
        .join(F.broadcast(nodes.select("cell", "arc", "shard")), "cell", "left").join(F.broadcast(counts), "cell", "left")
    )
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    node = F.when(F.col("arc").isNotNull(), F.struct("arc", "shard"))
    table = every.select(
        "cell", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.last(node, True).over(ahead), F.first(node, True).over(whole)).alias("node"),
    ).select("cell", "n", "node.arc", "node.shard", F.sum("n").over(whole).alias("all"))
    if slack:
        bound = (F.floor(F.col("all") * (1 + slack) / shards) + 1).cast("long")
    else:
        bound = F.floor(F.col("all") / shards).cast("long") + (F.col("shard") < F.col("all") % shards).cast("long")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    table = table.withColumn("bound", bound).withColumn("before", F.coalesce(before, F.lit(0)))
    table = table.withColumn("keep", F.greatest(F.lit(0), F.least(F.col("n"), F.col("bound") - F.col("before"))))
    off = F.sum(F.col("n") - F.col("keep")).over(Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    table = scratch.write(table.withColumn("off", F.coalesce(off, F.lit(0))).coalesce(1), "cells")

    home = table.groupBy("shard").agg(F.sum("keep").alias("home"), F.max("all").alias("all"))
    if slack:
        limit = f"cast(floor(all * {1 + slack} / {shards}) as bigint) + 1"
    else:
        limit = f"all div {shards} + if(s < all % {shards}, 1L, 0L)"
    homes = home.agg(F.max("all").alias("all"), F.map_from_entries(F.collect_list(F.struct("shard", "home"))).alias("homes"))
    room = homes.select(
        F.expr(f"transform(sequence(0, {shards - 1}), s -> {limit} - coalesce(try_element_at(homes, s), 0L))").alias("room")
    )
    left = (
        table.groupBy("arc").agg(F.sum(F.col("n") - F.col("keep")).alias("left")).filter("left > 0")
        .join(F.broadcast(nodes.select("arc", "met")), "arc")
    )
    moves = _overflow(left, room)
    per_arc = Window.partitionBy("arc").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    moves = (
        moves.join(F.broadcast(home.select("shard", "home")), "shard", "left")
        .withColumn("from", F.coalesce(F.sum("take").over(per_arc), F.lit(0)))
        .withColumn("slot", F.coalesce("home", F.lit(0)) + F.coalesce(F.sum("take").over(per_shard), F.lit(0)))
        .groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("from", "take", "shard", "slot"))).alias("moves"))
    )
    moves = scratch.write(moves.coalesce(1), "moves")

    ends = F.sum("_n").over(Window.partitionBy("_cell").orderBy(*own).rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("_end", ends).withColumn("_start", F.col("_end") - F.col("_n"))
    pieces = F.sequence("_start", F.col("_end") - 1, F.lit(PIECE).cast("long"))
    numbered = numbered.withColumn("_from", F.explode(pieces))
    numbered = numbered.withColumn("_rank", F.explode(F.sequence("_from", F.least(F.col("_from") + PIECE, F.col("_end")) - 1)))
    placed = numbered.join(
        F.broadcast(table.select(F.col("cell").alias("_cell"), F.col("shard").alias("_home"), "keep", "before", "arc", "off")), "_cell"
    ).join(F.broadcast(moves), "arc", "left")
    over = F.col("off") + F.col("_rank") - F.col("keep")
    placed = placed.withColumn("_over", over).withColumn(
        "_move", F.expr("get(filter(moves, m -> _over >= m.from and _over < m.from + m.take), 0)")
    )
    at_home = F.col("_rank") < F.col("keep")
    placed = placed.select(
        *[F.col(o).alias(c) for c, o in zip(kept, own)],
        F.when(at_home, F.col("_home")).otherwise(F.col("_move.shard")).cast("int").alias("shard"),
        F.when(at_home, F.col("before") + F.col("_rank")).otherwise(F.col("_move.slot") + F.col("_over") - F.col("_move.from")).cast("long").alias("slot"),
    )
    return scratch.result(placed)
