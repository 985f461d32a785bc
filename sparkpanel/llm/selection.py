"""Exact thresholds over a column without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
ROUNDS = 6


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """A number t such that the rows with ``column >= t`` are the k largest, and ties with the k-th.

    Each round counts the rows in equal bins of the current range and goes on
    in the bin that holds the k-th; at most BINS rows reach the driver.
    ``values`` is read once a round, so pass a written table.  Nulls don't
    count.  With k < 1, t is above every value.
    """
    values = values.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or not n:
        return float("inf")
    if k >= n:
        return low
    above = 0  # rows beyond the current range
    for _ in range(ROUNDS):
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).cast("int")
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in
                  values.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy(place.alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            size, lo, hi = counts[b]
            if above + size >= k:
                break
            above += size
        low, high = lo, hi
        if low == high or above + size == k:
            break
    return low
