"""Whole-row duplicates without shuffling the whole table.

Rows whose 64-bit hash occurs once cannot have a copy.  Counting hashes shuffles
eight bytes a row; only the rows behind a repeated hash are compared in full, so
a hash collision never costs a row.  When too many hashes repeat to broadcast,
the plain distinct, which combines copies on the map side, does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import col, fold_nan
from sparkprep.functions.lookup import Kept, fits_broadcast


def _row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*[col(c) for c in columns])


def repeated_hashes(folded: DataFrame, kept: Kept, columns: list[str] | None = None) -> DataFrame | None:
    """Row hashes seen more than once with their counts; None if too many."""
    counts = folded.groupBy(_row_hash(columns or folded.columns).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = kept.keep(counts.where("__n > 1"))
    return repeated if fits_broadcast(repeated) else None


def _behind(folded: DataFrame, repeated: DataFrame, kind: str, columns: list[str] | None = None) -> DataFrame:
    keyed = folded.withColumn("__h", _row_hash(columns or folded.columns))
    return keyed.join(F.broadcast(repeated), "__h", kind).drop("__h")


def first_of_equal(df: DataFrame, position: str, kept: Kept) -> DataFrame:
    """Of rows equal but for ``position`` the one where it is smallest, so that
    "keep the first" has a meaning; as below, only rows behind a repeated hash
    are shuffled as long as these are few."""
    folded = fold_nan(df)
    values = [c for c in df.columns if c != position]
    first = lambda rows: rows.groupBy(*[col(c) for c in values]).agg(F.min(col(position)).alias(position)).select(*[col(c) for c in df.columns])
    repeated = repeated_hashes(folded, kept, values)
    if repeated is None:
        return first(folded)
    if repeated.isEmpty():
        return folded
    return _behind(folded, repeated, "left_anti", values).unionByName(first(_behind(folded, repeated, "left_semi", values)))


def without_duplicates(df: DataFrame, kept: Kept) -> DataFrame:
    """One row of every set of equal rows; NULL equals NULL and NaN."""
    folded = fold_nan(df)
    repeated = repeated_hashes(folded, kept)
    if repeated is None:
        return folded.dropDuplicates()
    if repeated.isEmpty():
        return folded
    return _behind(folded, repeated, "left_anti").unionByName(_behind(folded, repeated, "left_semi").dropDuplicates())


def count_duplicates(df: DataFrame) -> int:
    """Rows equal to another one already counted."""
    folded, kept = fold_nan(df), Kept()
    repeated = repeated_hashes(folded, kept)
    if repeated is None:
        copies = folded.count() - folded.distinct().count()
    else:
        rows = repeated.agg(F.sum("__n")).first()[0] or 0
        copies = rows - _behind(folded, repeated, "left_semi").distinct().count() if rows else 0
    kept.release()
    return copies
