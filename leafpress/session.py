"""Session helpers: where lineage is cut, and settings the jobs rely on."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the folder checkpoints go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``; without that
    setting nothing can be written that all executors can read.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    With ``keep_partitioning`` later joins and groups on the columns ``df`` was
    repartitioned by need no exchange.  An adaptive plan does not tell how its
    result is partitioned, so this one write is planned without it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def shuffle_width(spark: SparkSession) -> int:
    """Slices to cut data into: the shuffle partitions, in local mode a few per core."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sc = spark.sparkContext
    return min(width, 2 * sc.defaultParallelism) if sc.master.startswith("local") else width


def few_tasks(df: DataFrame) -> DataFrame:
    """Merge the splits of a scan into at most 32 tasks a core, nothing is moved.

    Spark counts a small file as 4 MB, so a million of them would be 30,000 tasks, and as many files of a checkpoint.
    """
    return df.coalesce(32 * df.sparkSession.sparkContext.defaultParallelism)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context.

    Functions that run in workers import the package there.  The archive is made
    in the driver's own folder of this Spark context, and Spark hands it to the
    executors, so nothing has to be installed on them.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if not root.is_dir() or getattr(sc, "_leafpress_shipped", False):
        return  # read from an archive itself, or sent before
    archive = Path(sc._temp_dir) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._leafpress_shipped = True
