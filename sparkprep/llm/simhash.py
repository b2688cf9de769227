"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import col, components, kept, slices

SLICE = 4 << 20
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()  # bytes: lower() changes A-Z only, split() cuts at x20 and x09-x0D
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    digest, seed = xxhash.xxh64_intdigest, 42
    counts, total = np.zeros(64, np.int64), n - k + 1
    for at in range(0, total, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, total)].tolist(), ends[at + k - 1 : min(at + CHUNK, total) + k - 1].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)``, one row per document.  A null text counts as empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, texts in slices(batch, SLICE, "doc_id", "text"):
                found = [fingerprint(t, shingle) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> str:
    """SQL array of all words within ``radius`` bit flips of the long ``fp``."""
    out = "array(fp)"
    for _ in range(radius):
        out = f"array_distinct(flatten(transform({out}, v -> concat(array(v), transform(sequence(0, 63), i -> v ^ shiftleft(1L, i))))))"
    return out


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints ``fp`` within ``max_bits`` differing bits of each other.

    Two words differ in at most ``max_bits`` bits just if some word lies within
    half of that of both.  So every distinct fingerprint emits the words of its
    ball of half the radius, and fingerprints meet where they emit the same
    one.  All that meet are within the radius of each other, so a chain through
    them loses no connection; a group holds as many rows as a half ball has
    words at most (65 for two bits), however often a fingerprint occurs.
    """
    if max_bits < 0 or max_bits % 2:
        raise ValueError("max_bits must be even: a ball around the middle has half of it as radius")
    # a given number of partitions is not merged by size: the rows grow 65-fold behind it
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("fp").repartition(tasks, "fp").distinct()
    variants = distinct.select("fp", F.explode(F.expr(ball(max_bits // 2))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("b")).where("b is not null").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits.  ``component_id`` is the
    smallest doc_id reachable over fingerprints at most ``max_bits`` bits apart,
    the row's own included.  Null and empty texts have fingerprint zero and are
    linked like any other.  Rows with a null doc_id link others but are not
    counted for the minimum; a component of such rows alone has a null id.
    Repeated rows come back as often as given.  Other columns are not read.
    """
    rows = kept(fingerprints(docs, id_col, text_col, shingle))
    prints = kept(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = with_root(prints, max_bits)
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = joined.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_root(prints: DataFrame, max_bits: int) -> DataFrame:
    """``prints (fp, ...)`` with the smallest fingerprint of each one's component as ``root``."""
    roots = components(links(prints, max_bits)).withColumnRenamed("node", "fp")
    return prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row with all its columns for each component of ``near_duplicates``: that of the smallest doc_id.

    Of rows with equal ids, or none, the one with the least hash stays.
    """
    whole = F.xxhash64(*[col(c) for c in docs.columns]).alias("hash")
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), whole, F.struct("*").alias("row"))

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    marked = rows.select("doc_id", "hash", simhash(F.coalesce("text", F.lit("")).cast("binary")).alias("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")
    joined = with_root(kept(marked.groupBy("fp").agg(first)), max_bits)
    stay = joined.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.hash").alias("own")).distinct()
    found = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "left_semi")
    return found.dropDuplicates(["doc_id", "hash"]).select("row.*")
