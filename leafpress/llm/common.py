"""What the corpus operators share: the word rule, tables of one run, slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafpress.session import ensure_checkpoint_dir, ship_package

#: A word is a run of bytes other than these; ``bytes.split()`` cuts at the same ones.
SPACES = r"\x20\x09-\x0D"
WORD = f"[^{SPACES}]+"
#: Characters of text that a task holds at once, and rows in one Arrow batch.
SLICE_BYTES = 2 << 20
BATCH_ROWS = 1000


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, without building the list of words."""
    edges = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(edges, " \t\n\x0b\x0c\r", "")).cast("long")


def arrow_ready(spark: SparkSession) -> None:
    """Get ready for functions over Arrow batches: the workers have the package, and batches few rows.

    A batch of long texts has to fit in a Python worker.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have about ``limit`` bytes; one long text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Scratch:
    """Parquet tables of one run in the shared folder of the cluster, dropped once their readers are written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def result(self, df: DataFrame) -> DataFrame:
        """Write a narrow result to the checkpoint folder and drop the tables it was made from."""
        done = df.checkpoint(eager=True)
        self.drop()
        return done
