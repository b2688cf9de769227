"""The order in which files hold their rows, without a column that tells it.

Files come by path, rows as each file holds them.  Parquet rows have an index in
their file, which survives shuffles and lost executors.  Rows of other formats
get a place while they are read, so their order must be taken before anything
moves them.  Where a frame is not read from files there is no such order.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import col
from sparkprep.functions.lookup import Kept, lookup_join
from sparkprep.functions.ranks import running_start
from sparkprep.session import cut_lineage

FILE, PLACE = "__file", "__place"
SCHEME = "^([A-Za-z0-9+.-]+):/+"


def _metadata(df: DataFrame, field: str) -> Column | None:
    try:
        found = df.metadataColumn("_metadata").getField(field)
        df.select(found).schema  # noqa: B018  resolves it
    except AnalysisException:
        return None
    return found


def _addressed(df: DataFrame) -> tuple[DataFrame, bool] | None:
    """``df`` plus the file (and block) of each row and its place there, and
    whether places are row indexes; None if the rows are not read from files."""
    path = _metadata(df, "file_path")
    if path is None:
        return None
    index = _metadata(df, "row_index")
    if index is not None:
        return df.withColumns({FILE: path, PLACE: index}), True
    start = _metadata(df, "file_block_start")
    block = F.format_string("%s %020d", path, start)
    return df.withColumns({FILE: block, PLACE: F.monotonically_increasing_id()}), False


def with_place(df: DataFrame, name: str) -> DataFrame | None:
    """``df`` plus a struct that sorts rows as the files hold them; None if not read from files."""
    found = _addressed(df)
    if found is None:
        return None
    return found[0].select(*[col(c) for c in df.columns], F.struct(FILE, PLACE).alias(name))


def first_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of the first files that hold ``rows`` rows together, or of all.

    The number of files tried doubles; the scan leaves out the others by their
    paths, so a small head of a large table opens few files.
    """
    path = _metadata(df, "file_path")
    if path is None:
        return df
    # Spark writes the start of a path in two forms: file:/x and file:///x.
    path = F.regexp_replace(path, SCHEME, "$1:/")
    names = sorted(re.sub(SCHEME, r"\1:/", n) for n in df.inputFiles())
    tried = 1
    while tried < len(names):
        part = df.where(path <= names[tried - 1])
        if part.select(path).limit(rows).count() >= rows:
            return part
        tried *= 2
    return df


def with_row_numbers(df: DataFrame, name: str = "row", kept: Kept | None = None) -> DataFrame:
    """``df`` plus each row's number in the files, from 0.

    Numbers are consecutive for whole tables; where a filter came before, later
    rows still have larger ones.  One pass finds the extent of every file, whose
    running totals are formed on Spark and joined back by measured size: no
    global sort.  Formats without a row index are copied once to the shared folder with
    the places they were read at, as a second reading may cut the files otherwise.
    """
    if name in df.columns:
        raise ValueError(f"column '{name}' exists")
    found = _addressed(df)
    if found is None:
        raise ValueError("rows that are not read from files have no order")
    rows, indexed = found
    if not indexed:
        rows = cut_lineage(rows, required=True)
    first = F.lit(0).cast("long") if indexed else F.min(PLACE)
    kept = Kept() if kept is None else kept
    extents = rows.groupBy(FILE).agg(first.alias("__first"), F.max(PLACE).alias("__last"), F.count(F.lit(1)).alias("__rows"))
    extents = kept.keep(extents)
    starts = running_start(extents, FILE, F.col("__last") - F.col("__first") + 1)
    offsets = starts.select(FILE, "__rows", (F.col("start") - F.col("__first")).alias("__offset"))
    numbered = lookup_join(rows, offsets, {FILE: F.col(FILE)}, "__rows", kept)
    return numbered.select(*[col(c) for c in df.columns], (F.col("__offset") + F.col(PLACE)).alias(name))
