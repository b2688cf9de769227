"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.session import cut_lineage


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: later passes read the copy and survive lost executors."""
    return cut_lineage(df, required=True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (a, b)``; the root is the smallest node reachable.

    Alternating large-star and small-star steps.  Each step takes the minimum
    per node with map-side combine and joins it back, so a node with very many
    neighbours never meets in one task.  An empty table gives an empty table.
    """

    def state(df: DataFrame) -> tuple:
        # different edges look alike with a chance of about 2^-128 a round: sums of two 64-bit hashes, without overflow
        sums = [F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]
        return tuple(df.agg(F.count("*"), *sums).first())

    edges = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to its minimum
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below it go to the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = kept(moved.select("e.a", "e.b").where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def slices(batch, size: int, *columns: str) -> Iterator[tuple[list, ...]]:
    """Lists of the columns of an Arrow batch, as many rows at a time as hold ``size`` bytes of the last column (one row at least)."""
    import numpy as np
    import pyarrow as pa

    last = batch.column(batch.schema.get_field_index(columns[-1]))
    lengths = pa.compute.fill_null(pa.compute.binary_length(last), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        part = batch.slice(start, stop - start)
        yield tuple(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns)
        start = stop


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)
