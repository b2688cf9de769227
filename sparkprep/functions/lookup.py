"""Attach a lookup table to rows: broadcast when proven small, else skew-safe.

A table beyond the broadcast limit is joined by shuffle, except for its heavy
keys: a key owning more than one in ``HEAVY_SHARE`` rows can occur at most
``HEAVY_SHARE`` times among the keys, so that part is always small enough to
broadcast unless its texts are very long, and the hot rows never meet in one
shuffle partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import col

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HEAVY_SHARE = 1_000


class Kept:
    """Small persisted frames of one fit, released together."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.frames.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.frames[-1]

    def release(self) -> None:
        while self.frames:
            self.frames.pop().unpersist()


def fits_broadcast(table: DataFrame) -> bool:
    """Measured rows and bytes of the table, against the broadcast limits."""
    width = [F.octet_length(col(f.name).cast("string")) + F.lit(16) for f in table.schema.fields]
    size = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(16)) for w in width])).alias("bytes"),
    ).first()
    return size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: dict[str, Column],
    count: str,
    kept: Kept,
    how: str = "left",
    null_safe: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """``df`` with the non-key columns of ``table``.

    ``keys`` maps each key column of ``table`` to the matching expression on
    ``df``; ``count`` names the column of ``table`` telling how many rows of
    ``df`` carry the key.  Keys of ``table`` are unique, so no row multiplies.
    """
    names = {k: f"__lk{i}" for i, k in enumerate(keys)}
    values = [c for c in table.columns if c not in keys]
    extra = [c for c in values if c not in df.columns]
    keyed = df.withColumns({names[k]: e for k, e in keys.items()})
    side = table.select(*[col(k).alias(f"__r{names[k]}") for k in keys], *[col(v) for v in extra], col(count).alias("__n"))

    def matches() -> Column:
        pairs = [
            F.col(n).eqNullSafe(F.col(f"__r{n}")) if null_safe else F.col(n) == F.col(f"__r{n}") for n in names.values()
        ]
        return reduce(lambda a, b: a & b, pairs)

    def attach(rows: DataFrame, lookup: DataFrame, kind: str) -> DataFrame:
        joined = rows.join(lookup, matches(), kind)
        return joined.select(*[col(c) for c in df.columns], *[col(v) for v in extra])

    if small is None:
        small = fits_broadcast(table)
    if small:
        return attach(keyed, F.broadcast(side), how)
    total = table.agg(F.sum(col(count))).first()[0] or 0
    heavy = kept.keep(side.where(F.col("__n") > F.lit(total / HEAVY_SHARE)))
    if not fits_broadcast(heavy):  # few but very long keys: one shuffle, whose skewed partitions adaptive execution splits
        return attach(keyed, side, how)
    light = side.where(F.col("__n") <= F.lit(total / HEAVY_SHARE))
    hot = attach(keyed, F.broadcast(heavy), "inner")
    others = keyed.join(F.broadcast(heavy), matches(), "left_anti")
    has_key = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names.values()])
    parts = [hot]
    if null_safe:
        parts.append(attach(others, light, how))
    else:
        # Rows without a key match nothing; keep them out of the shuffle.
        parts.append(attach(others.where(has_key), light, how))
        if how == "left":
            blanks = [F.lit(None).cast(table.schema[v].dataType).alias(v) for v in extra]
            parts.append(others.where(~has_key).select(*[col(c) for c in df.columns], *blanks))
    return reduce(DataFrame.unionByName, parts)
