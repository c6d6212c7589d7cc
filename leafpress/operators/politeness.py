"""Fetch schedule with a least distance between requests to one host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafpress.operators.skew import rank_slices, running, sliced


def polite_schedule(
    requests: DataFrame, delay_us: int = 1_000_000, host: str = "host", arrival: str = "arrival_us", tie: str = "request_id"
) -> DataFrame:
    """Add ``start_us``: never before the arrival, nor ``delay_us`` after the host's last start.

    With n the place of a request at its host, the start is
    ``delay * n + max(arrival_j - delay * j)`` over the requests j up to n.  Both
    n and the running maximum are taken over slices of the order, so a host with
    any share of the requests is worked on by many tasks.
    """
    order = [arrival, tie]
    numbered = rank_slices(sliced(requests, [host], order), [host], order, "n")
    shifted = numbered.withColumn("_free", F.col(arrival) - F.col("n") * delay_us)
    scheduled = running(shifted, [host], order, "_free", "_max", "max")
    return scheduled.withColumn("start_us", F.col("_max") + F.col("n") * delay_us).drop("_free", "_max", "_slice")
