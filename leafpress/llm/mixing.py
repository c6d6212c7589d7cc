"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of a source stand in a seeded order, and their words, end to end,
are cut into blocks of ``block`` words.  Seats, as many as the mix has blocks, go
to the sources by highest quotients target / (2k + 1); a shard of the mix is a
stretch of that sequence of seats, so each shard gets an integer quota of blocks
from each source.  A source whose quota is more than its blocks is taken whole as
often as it goes in; the rest of the quota is spread from a seeded offset over
its blocks in their seeded order.

Only running sums of the sizes (on range slices, so that a source with a third of
all rows is spread over tasks) and tables with a few rows for each source and
shard are needed: seats are never listed, but for those about a threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafpress.llm.common import Scratch, arrow_ready, n_words, slices
from leafpress.operators.skew import ranked, running, sliced

#: Weights by the place of a source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words in a block, and shards of the mix.
BLOCK = 32
SHARDS = 16


def seeded(seed: int, column: Column) -> Column:
    """A 60-bit number from a digest that any SQL engine has."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _key(id_: str, source: str, text: str) -> Column:
    """Equal for rows with equal id, source and text, null or not."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in (id_, source)]
    return F.md5(F.concat_ws("|", *[F.md5(p) for p in parts], F.coalesce(F.md5(F.col(f"`{text}`")), F.lit("-"))))


def add_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target`` to sources with their ``source_size`` and ``weight``.

    Targets are in proportion to the weights, add up to ``share`` times all sizes
    and stop at ``most`` times a source's size; what is beyond goes to the others by
    weight, until none is above.  A round brings two sums to the driver, and lifts
    the level that open sources get for each unit of weight.
    """
    cap = F.col("source_size") * F.lit(float(most))
    total = float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level = 0.0
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        full = F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0))
        full, weight = sources.agg(full, F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        lifted = (total - full) / weight if weight else level
        if lifted <= level:
            return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))
        level = lifted


def quotas(sources: DataFrame, block: int, shards: int) -> DataFrame:
    """Blocks (``quota``) that each shard takes of each source, and how many the shards before it take.

    Sources come with ``place`` (unique), ``target`` and ``blocks``; ties of
    quotients go to the earlier place.  With T the sum of the targets and n
    sources, the seats of a quotient of T / x at least are x / 2 in all, give or
    take n / 2.  So the first e seats hold all those of x = 2e - n - 2 and lie
    among those of x = 2e + n + 2; only the few between are ranked.  A source's
    quotas end at two takes of each of its blocks.
    """
    total, n = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    # sums of doubles depend on their order in the last places: these must not decide a half
    seats = int(round(total, 3) / block + 0.5)

    def held(x: Column) -> Column:
        share = F.col("target") * x / F.lit(max(2 * total, 1.0))
        return F.greatest(F.lit(0), F.floor(share + F.lit(0.5))).cast("long")

    end = F.floor((F.col("shard") + 1) * F.lit(seats) / F.lit(shards)).cast("long")
    spread = sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("end", end)
    spread = spread.withColumn("sure", held(2 * F.col("end") - F.lit(n + 2))).withColumn("may", held(2 * F.col("end") + F.lit(n + 2)))
    open_ = spread.filter("may > sure").withColumn("k", F.explode(F.sequence("sure", F.col("may") - 1)))
    order = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "place", "k")
    left = spread.groupBy("shard").agg((F.max("end") - F.sum("sure")).alias("left"))
    won = (
        open_.withColumn("rank", F.row_number().over(order)).join(left, "shard").filter("rank <= left")
        .groupBy("place", "shard").agg(F.count(F.lit(1)).alias("won"))
    )
    upto = F.least(F.col("sure") + F.coalesce("won", F.lit(0)), 2 * F.col("blocks"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    return (
        spread.join(won, ["place", "shard"], "left").withColumn("upto", upto)
        .select("place", "shard", before.alias("before"), (F.col("upto") - before).alias("quota"))
    )


def _chosen_before(i: Column) -> Column:
    """How many of a source's blocks before block i are taken once more than the others."""
    return F.floor((i + F.col("offset")) * F.col("rest") / F.col("blocks")) - F.floor(F.col("offset") * F.col("rest") / F.col("blocks"))


def mix_plan(
    df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", *, share: float = 1.5, most: float = 2.0,
    block: int = BLOCK, shards: int = SHARDS, seed: int = 7, scratch: Scratch | None = None,
) -> DataFrame:
    """What the mix takes of each row of ``df``: one row each, with

    the id, ``source``, ``size`` (words), ``source_size``, ``target`` (its
    source's), ``copies`` (times it is taken whole), ``blocks`` (stretches of words
    taken once more: first word, 0-based, and number) and ``taken`` (words in all).
    ``key`` and ``copy`` name the row: equal for equal rows, which ``copy`` numbers.

    A null text has no words; null sources are one source, the last; null ids and
    repeated rows are documents like any other.  An empty table gives an empty
    plan, and a table without words one in which nothing is taken.
    """
    own = scratch or Scratch(df.sparkSession, "mix")  # the caller's, to be dropped once the plan is written
    rows = df.select(
        F.col(f"`{id_}`").alias("id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"),
        _key(id_, source, text).alias("key"),
    )
    rows = own.write(rows.groupBy("id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "rows")
    flag = F.when(F.col("source").isNull(), 1).otherwise(0)
    named = [flag.alias("none"), F.coalesce("source", F.lit("")).alias("name")]
    sources = rows.groupBy(*named).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = ranked(sources, [], ["none", "name"], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = own.write(sources.withColumn("weight", weight).withColumn("blocks", F.ceil(F.col("source_size") / block)), "sources")
    sources = own.write(add_targets(sources, share, most), "targets")
    whole = quotas(sources, block, shards).groupBy("place").agg(F.sum("quota").alias("quota"))
    per = F.greatest(F.col("blocks"), F.lit(1))
    sources = own.write(
        sources.join(whole, "place").select(
            "none", "name", "place", "source_size", "target", per.alias("blocks"), F.floor(F.col("quota") / per).alias("copies"),
            (F.col("quota") % per).alias("rest"), (seeded(seed, F.col("place")) % per).alias("offset"),
        ), "taken",
    )
    placed = rows.withColumns({"none": flag, "name": F.coalesce("source", F.lit(""))}).join(sources.select("none", "name", "place"), ["none", "name"])
    order = placed.select("id", "source", "size", "key", "n", "place", seeded(seed, F.col("id")).alias("h"), (F.col("size") * F.col("n")).alias("all"))
    ends = running(sliced(order, ["place"], ["h", "id", "key"]), ["place"], ["h", "id", "key"], "all", "class_end", "sum")
    docs = ends.join(sources.drop("none", "name"), "place").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("class_end") - F.col("all") + F.col("copy") * F.col("size")
    docs = docs.withColumn("start", start).withColumn("stop", F.col("start") + F.col("size"))
    docs = docs.withColumn("b0", F.floor(F.col("start") / block)).withColumn("b1", F.floor((F.col("stop") - 1) / block))
    listed = F.transform(
        F.filter(
            F.sequence("b0", "b1"),
            lambda b: _chosen_before(b + 1) > _chosen_before(b),
        ),
        lambda b: F.struct(
            (F.greatest(b * block, F.col("start")) - F.col("start")).cast("int").alias("first"),
            (F.least((b + 1) * block, F.col("stop")) - F.greatest(b * block, F.col("start"))).cast("int").alias("words"),
        ),
    )
    none = F.array().cast("array<struct<first:int,words:int>>")
    docs = docs.withColumn("taken_blocks", F.when((F.col("size") > 0) & (F.col("rest") > 0), listed).otherwise(none))
    more = F.aggregate("taken_blocks", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return docs.select(
        F.col("id").alias(id_), F.col("source").alias(source), "key", F.col("copy").cast("int").alias("copy"), "size", "source_size", "target",
        F.col("copies").cast("int").alias("copies"), F.col("taken_blocks").alias("blocks"), (F.col("copies") * F.col("size") + more).alias("taken"),
    )


def mixed_documents(df: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, as often as they are taken, with their own columns.

    A row stands once for each time it is taken whole, and once more with the
    stretches of its text that are taken beyond that; white space within a stretch
    stays as it is.  Rows of which nothing is taken are left out.
    """
    scratch = Scratch(df.sparkSession, "mix")
    plan = mix_plan(df, id_, text, source, scratch=scratch, **options).filter("taken > 0")
    plan = scratch.result(plan.select("key", "copy", "copies", "blocks"))
    # columns go by number, so none of the caller's can clash with ours
    names = [f"c{i}" for i in range(len(df.columns))]
    own = {c: names[df.columns.index(c)] for c in (id_, source, text)}
    numbered = df.toDF(*names).withColumn("key", _key(own[id_], own[source], own[text]))
    numbered = numbered.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1)
    taken = numbered.join(plan, ["key", "copy"])
    arrow_ready(df.sparkSession)
    schema = df.schema
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = re.compile(r"[^ \t-\r]+[ \t-\r]*")
        for part in slices(batches, names[place]):
            at, texts = [], []
            rows = zip(part.column(place).to_pylist(), part.column("copies").to_pylist(), part.column("blocks").to_pylist())
            for i, (own, copies, blocks) in enumerate(rows):
                stands = [own] * copies
                if blocks:
                    pieces = piece.findall(own)
                    stands.append("".join(p for b in blocks for p in pieces[b["first"] : b["first"] + b["words"]]))
                texts += stands
                at += [i] * len(stands)
            index = pa.array(at, pa.int64())
            columns = [pa.array(texts, part.column(i).type) if i == place else part.column(i).take(index) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return taken.select(*names, "copies", "blocks").mapInArrow(run, schema)
