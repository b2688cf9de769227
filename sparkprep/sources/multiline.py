"""CSV records that span lines, read by as many tasks as the files have blocks.

Whether a line starts a record depends on all quotes before it.  A line, and so
a block of lines, maps the state at its start (outside or inside a quoted
field) to the state at its end.  One pass finds that map for each block; the
maps are composed over the blocks of a file, one row each; with the state at
its start known, every block is cut into records on its own.  What a border
cuts comes out as fragments and is joined by block order.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.session import cut_lineage

#: Blocks whose start needs telling that are broadcast (under 300 bytes each); more are joined by a shuffle of the lines.
BROADCAST_BLOCKS = 100_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts ``inside`` a quoted field, or else at a record's start, ends inside one.

    A field is quoted if its first character is a quote; two quotes in it stand
    for one; after the closing quote everything up to the comma is plain text.
    Quotes within plain fields have no meaning."""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find(',"') + 2
            if at == 1:
                return False
    while True:
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        at = line.find(",", at + 1)
        if at < 0:
            return False
        # the next field that starts with a quote
        at = line.find(',"', at) + 2
        if at == 1:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, value)``: the lines of a block are neighbours, in the file's order."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch) -> Iterator[tuple[str, int, int, int]]:
    """``(file, block, start, stop)``: the rows of a batch by file and block."""
    import numpy as np
    import pyarrow.compute as pc

    files, blocks = batch.column(0), batch.column(1)
    borders = np.flatnonzero(np.diff(blocks.to_numpy())) + 1
    stops = np.union1d(borders, np.asarray(pc.run_end_encode(files).run_ends)).tolist()
    start = 0
    for stop in stops:
        yield files[start].as_py(), blocks[start].as_py(), start, stop
        start = stop


def _block_maps(batches: Iterator) -> Iterator:
    """One row per block: the states its lines, of which those with quotes are given, end in."""
    import pyarrow as pa

    def row(file: str, block: int, outside: bool, inside: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [file], "block": [block], "from_outside": [outside], "from_inside": [inside]})

    now: tuple | None = None
    outside, inside = False, True
    for batch in batches:
        for file, block, start, stop in _runs(batch):
            if (file, block) != now:
                if now:
                    yield row(*now, outside, inside)
                now, outside, inside = (file, block), False, True
            for value in batch.column(2).slice(start, stop - start).to_pylist():
                same = outside == inside
                outside = ends_inside(value, outside)
                inside = outside if same else ends_inside(value, inside)
    if now:
        yield row(*now, outside, inside)


def _cut(batches: Iterator) -> Iterator:
    """The records of each block: whole ones, and the fragments at its borders."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows(now: tuple, opens: bool, closes: bool, first: int, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        flags = [pa.repeat(pa.scalar(flag), n) for flag in (opens, closes)]
        marks = pa.array(np.arange(n) == first)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now[0]), n), pa.repeat(pa.scalar(now[1], pa.int64()), n), *flags, marks, records], ["file", "block", "opens", "closes", "first", "record"])

    now: tuple | None = None
    opens, inside, header = True, False, False
    waiting: list[str] = []  # lines of the record that is open
    for batch in batches:
        for file, block, start, stop in _runs(batch):
            if (file, block) != now:
                if waiting:
                    yield rows(now, opens, False, 0 if header and opens else -1, pa.array(["\n".join(waiting)]))
                now, waiting, header = (file, block), [], batch.column(4)[start].as_py()
                inside = batch.column(3)[start].as_py()
                opens = not inside
            lines = batch.column(2).slice(start, stop - start)
            quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
            after = np.empty(len(lines), bool)
            at = 0
            for i, value in zip(quoted.tolist(), lines.take(pa.array(quoted)).to_pylist()):
                after[at:i] = inside
                after[i] = inside = ends_inside(value, inside)
                at = i + 1
            after[at:] = inside
            ends = np.flatnonzero(~after) + 1
            if not len(ends):
                waiting += lines.to_pylist()
                continue
            record = "\n".join(waiting + lines[: ends[0]].to_pylist())
            mark = header and opens and bool(record.strip())
            yield rows(now, opens, True, 0 if mark else -1, pa.array([record]))
            header, opens = header and not mark, True
            records = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines), "\n")
            mark = next((i for i, r in enumerate(records) if r.as_py().strip()), -1) if header else -1
            yield rows(now, True, True, mark, records)
            header = header and mark < 0
            waiting = lines[ends[-1] :].to_pylist()
    if waiting:
        yield rows(now, opens, False, 0 if header and opens else -1, pa.array(["\n".join(waiting)]))


def _starts(lines: DataFrame) -> DataFrame:
    """``(file, block, starts_inside, header)`` of the blocks that start inside a field or hold their file's first record."""
    maps = lines.where(F.contains("value", F.lit('"'))).mapInArrow(_block_maps, "file string, block long, from_outside boolean, from_inside boolean")
    # every block, also those without a quote, whose map is the identity
    blocks = lines.groupBy("file", "block").agg(F.max(F.trim("value") != "").alias("filled"))
    maps = blocks.join(maps, ["file", "block"], "left").select("file", "block", "filled", F.coalesce("from_outside", F.lit(False)).alias("from_outside"), F.coalesce("from_inside", F.lit(True)).alias("from_inside"))
    order = Window.partitionBy("file").orderBy("block")
    # a map is constant, the identity or a swap: the last constant and the swaps since give the state
    constant = F.col("from_outside") == F.col("from_inside")
    runs = maps.withColumn("run", F.sum(constant.cast("int")).over(order))
    since = Window.partitionBy("file", "run").orderBy("block")
    swaps = F.sum((~constant & F.col("from_outside")).cast("int")).over(since)
    base = F.first(F.when(constant, F.col("from_outside")).otherwise(False)).over(since)
    ends = runs.withColumn("ends_inside", base != (swaps % 2 == 1))
    starts = ends.select(
        "file",
        "block",
        F.lag("ends_inside", 1, False).over(order).alias("starts_inside"),
        (F.col("block") == F.min(F.when(F.col("filled"), F.col("block"))).over(Window.partitionBy("file"))).alias("header"),
    )
    return starts.where("starts_inside or header")


def splittable(spark: SparkSession, path: str) -> bool:
    """Whether ``\\n`` ends every line: a carriage return elsewhere may end a record, too, and needs the reader of whole files."""
    return spark.read.text(path, lineSep="\n").where(F.col("value").rlike("\r(?s:.)")).limit(1).isEmpty()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record)``: the text of every record but each file's first, blank ones left out.

    Fields may hold line breaks anywhere; blocks are cut in parallel.  A quote
    never closed runs to the end of its file.  No block is read as a whole: a
    task holds one record, and the fragments of one record meet in one task.
    """
    lines = _lines(spark, path)
    starts = cut_lineage(_starts(lines))
    if starts.count() <= BROADCAST_BLOCKS:
        told = lines.join(F.broadcast(starts), ["file", "block"], "left")
    else:
        numbered = lines.withColumn("place", F.monotonically_increasing_id()).repartition("file", "block")
        told = numbered.join(starts, ["file", "block"], "left").sortWithinPartitions("file", "block", "place")
    told = told.select("file", "block", "value", F.coalesce("starts_inside", F.lit(False)).alias("starts_inside"), F.coalesce("header", F.lit(False)).alias("header"))
    cut = cut_lineage(told.mapInArrow(_cut, "file string, block long, opens boolean, closes boolean, first boolean, record string"))
    whole = cut.where("opens and closes").select("first", "record")
    # at most two fragments a block: the end of a record from before comes first
    order = Window.partitionBy("file").orderBy("block", F.col("opens"))
    parts = cut.where("not (opens and closes)").withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    joined = parts.groupBy("file", "number").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "record"))).alias("p"))
    joined = joined.select("first", F.array_join(F.col("p.record"), "\n").alias("record"))
    return whole.union(joined).where(~F.col("first") & (F.trim("record") != "")).select("record")
