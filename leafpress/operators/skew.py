"""Joins and orderings that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafpress.session import cut_lineage, shuffle_width

HEAVY_KEYS = 1000
HEAVY_ROWS = 100_000


def _key_hash(on: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in on]))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of a large left side with a right side that is unique per key.

    The heaviest keys of the left side (at most 1000, so their list is small
    whatever the size of the input) get a salt for each 100,000 rows, and the right
    rows of just these keys are repeated per salt, so a task's share of a key does
    not grow with the key.  Any other key holds less than a thousandth of the rows,
    and is left to the adaptive plan.  The list is joined by 128-bit hashes of the keys.  Left-side NULL keys match nothing, as usual.  The
    left side is read twice (once for its keys alone), so write it out first if
    it is costly to compute.  The sides meet in a sort-merge join: what Spark takes for the size of a right
    side may be far below its rows, and a broadcast would bring them all through the driver.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    heavy = (
        left.select(*on).dropna().select(_key_hash(on).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_key").limit(HEAVY_KEYS)
        .filter(F.col("_n") > HEAVY_ROWS).select("_key", F.ceil(F.col("_n") / HEAVY_ROWS).cast("int").alias("_salts"))
    )
    # maps cannot be hashed
    hashed = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    own = F.xxhash64(*hashed)
    # rows without a key match nothing: they are dealt out by themselves
    salted_left = left.withColumn("_key", _key_hash(on)).join(F.broadcast(heavy), "_key", "left").withColumn(
        "_salt",
        F.when(F.col(on[0]).isNull(), -1 - F.pmod(own, F.lit(1 << 20))).otherwise(F.pmod(own, F.coalesce("_salts", F.lit(1)))).cast("int"),
    )
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.withColumn("_key", _key_hash(on)).join(F.broadcast(heavy), "_key", "left").withColumn("_salt", F.explode(copies))
    return salted_left.drop("_salts", "_key").join(salted_right.drop("_salts", "_key").hint("merge"), [*on, "_salt"], how).drop("_salt")


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in slices of the order (keys, order); a hot key gets many slices.

    The slice borders come from sampling, so the result is written out once and
    every later step sees the same slices.
    """
    n = shuffle_width(df.sparkSession)
    cut = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
    return cut_lineage(cut.withColumn("_slice", F.spark_partition_id()))


def carry(slices: DataFrame, keys: list[str], value: Column, name: str, combine) -> DataFrame:
    """What the earlier slices of the same key add up to, per (key, slice).

    Only slices which continue a key of an earlier slice get a row.  Slices are
    ranges of the key order, so each can continue one key at most: the result
    has no more rows than there are slices, and may be broadcast.
    """
    totals = slices.groupBy(*keys, "_slice").agg(value.alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, combine("_v").over(before)).filter(F.col(name).isNotNull()).drop("_v")


def _attach(slices: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    return slices.join(F.broadcast(carried), [*keys, "_slice"], "left")


def rank_slices(slices: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """1-based position of each row within its key, on sliced rows."""
    local = Window.partitionBy("_slice", *keys).orderBy(*order)
    carried = carry(slices, keys, F.count(F.lit(1)), "_before", F.sum)
    return (
        _attach(slices, keys, carried)
        .withColumn(out, (F.row_number().over(local) + F.coalesce(F.col("_before"), F.lit(0))).cast("long"))
        .drop("_before")
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """``row_number`` over (keys, order) that never puts a whole key in one task.

    ``order`` must be unique within a key.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    return rank_slices(sliced(df, keys, order), keys, order, out).drop("_slice", "_all")


def running(slices: DataFrame, keys: list[str], order: list[str], value: str, out: str, how: str) -> DataFrame:
    """Running 'max' or 'sum' of ``value`` up to and including each row, on sliced rows."""
    local = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    agg = {"max": F.max, "sum": F.sum}[how]
    carried = carry(slices, keys, agg(value), "_before", agg)
    here = agg(value).over(local)
    joined = F.greatest(here, F.col("_before")) if how == "max" else here + F.coalesce(F.col("_before"), F.lit(0))
    return _attach(slices, keys, carried).withColumn(out, joined).drop("_before")
