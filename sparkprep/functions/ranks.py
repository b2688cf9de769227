"""Running totals over a frame of distinct keys in their order."""

from __future__ import annotations

from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS = 50_000  # keys wanted in a range
MAX_RANGES = 2_000
SAMPLE = 8  # keys read to the driver for each range


def passed(bounds: list[Any], x: Column, test=lambda x, bound: x >= bound) -> Column:
    """How many of the ascending ``bounds`` the value has passed: a binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    edges = F.lit(bounds)
    steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])
    fits = lambda at, step: (at + step <= len(bounds)) & test(x, F.get(edges, at + step - 1))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def running_start(df: DataFrame, order: str, weight: Column, range_rows: int = RANGE_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` plus ``start``: the sum of ``weight`` over all smaller ``order`` keys.

    ``order`` must be unique and not null.  Keys fall into ranges by bounds taken
    from the keys with the smallest hash, so a key's range is the same in every
    pass and after a lost executor.  Each range sums its own keys in order;
    one total per range reaches the driver.  All sizes take this way; ``rows``
    saves the count where it is known, and a single range needs no totals.
    """
    rows = df.count() if rows is None else rows
    ranges = min(MAX_RANGES, rows // range_rows + 1)
    bounds: list[Any] = []
    if ranges > 1:
        picked = df.select(order).orderBy(F.xxhash64(order), order).limit(SAMPLE * ranges)
        keys = [r[0] for r in picked.orderBy(order).collect()]
        bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)]
    placed = df.withColumn("__w", weight.cast("long")).withColumn("__part", passed(bounds, F.col(order)))
    totals = {r["__part"]: r["t"] for r in placed.groupBy("__part").agg(F.sum("__w").alias("t")).collect()} if bounds else {}
    offsets = [0, *accumulate(totals.get(i, 0) for i in range(len(bounds)))]
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__w").over(inside), F.lit(0)) + F.get(F.lit(offsets), F.col("__part"))
    return placed.withColumn("start", start.cast("long")).drop("__w", "__part")
