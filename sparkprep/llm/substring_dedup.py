"""Repeated passages removed by hashing of lines and their sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import col, kept, slices

SLICE = 4 << 20
#: A unit ends after a line break or after a sentence, with the white space that follows.
UNIT = r"(?s).+?(?:\. [ \t\n\r]*|\n[ \t\n\r]*|\z)"
#: Fine units also end after "! " and "? ", and longer sentences after words whose hash with those before it is the
#: least of NEAR neighbours.  So two cuts at most NEAR words apart, the same in every copy, and 50 equal words hold whole units of 8 or more.
FINE = UNIT.replace(r"\. ", "[.!?] ")
CONTEXT, NEAR = 3, 10
WORDS = re.compile(r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*")
ROW = "doc_id long, body long, start int, length int, words int, d1 long, d2 long"


def split_long(raw: str) -> list[str]:
    """A sentence cut at places that its words alone determine; one of few words stays whole."""
    import xxhash

    words = WORDS.findall(raw) if raw.strip(" \t\n\r\x0b\x0c") else []
    if len(words) < CONTEXT + NEAR:
        return [raw]
    bare = [w.encode().lower().strip() for w in words]
    rank = [xxhash.xxh3_64_intdigest(b" ".join(bare[i - CONTEXT : i])) for i in range(CONTEXT, len(words))]
    cuts, last = [], -1
    for a in range(len(rank) - NEAR + 1):
        end = a + NEAR
        if last < a:  # the least, the last of equal ones
            last = max(range(a, end), key=lambda i: (-rank[i], i))
        elif rank[end - 1] <= rank[last]:
            last = end - 1
        else:
            continue
        cuts.append(last + CONTEXT)
    edges = [0, *cuts, len(words)]
    return ["".join(words[a:b]) for a, b in zip(edges, edges[1:])]


def units(docs: DataFrame, fine: bool = False) -> DataFrame:
    """``ROW`` for every unit with a word: code-point offset and length, words, and the 128-bit digest of the unit with
    A-Z lower-cased and white space runs as one blank; ``body`` is a hash of the whole text."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        whole_units = re.compile((FINE if fine else UNIT).replace(r"\z", r"\Z")).findall
        cut = (lambda text: [u for raw in whole_units(text) for u in split_long(raw)]) if fine else whole_units
        digest, whole = xxhash.xxh128_digest, xxhash.xxh3_64_intdigest
        for batch in batches:
            for ids, texts in slices(batch, SLICE, "doc_id", "text"):
                keys, bodies, starts, lengths, words, found = [], [], [], [], [], []
                for i, text in zip(ids, texts):
                    body = whole(text.encode()) - (1 << 63)
                    at = 0
                    for raw in cut(text):
                        tokens = raw.encode().lower().split()
                        if tokens:
                            keys.append(i)
                            bodies.append(body)
                            starts.append(at)
                            lengths.append(len(raw))
                            words.append(len(tokens))
                            found.append(digest(b" ".join(tokens)))
                        at += len(raw)
                both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                arrays = [pa.array(keys, pa.int64()), pa.array(bodies, pa.int64()), *(pa.array(x, pa.int32()) for x in (starts, lengths, words))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["doc_id", "body", "start", "length", "words", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, ROW)


def repeated_spans(docs: DataFrame, min_words: int = 8, fine: bool = False) -> DataFrame:
    """``(doc_id, body, spans array<struct<start,stop>>)`` for documents with passages to remove.

    A unit repeats if a unit of equal digest stands earlier, by doc_id (null
    first), then offset.  Repeating units that follow each other form a passage;
    passages of ``min_words`` words or more are removed, shorter chance repeats
    stay.  The digest's first occurrence is found with map-side combine; only
    digests seen more than once are joined back.
    """
    found = kept(units(docs, fine))
    at = F.struct("doc_id", "start")
    first = found.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").drop("n")
    first = kept(first)  # read again it is dealt out anew, so that a join can split a digest with very many units
    again = found.join(first, ["d1", "d2"]).where(at > F.col("first")).select("doc_id", "body", "start", "length", "words").distinct()
    own = Window.partitionBy("doc_id", "body").orderBy("start")
    new = F.coalesce((F.lag(F.col("start") + F.col("length")).over(own) != F.col("start")).cast("int"), F.lit(1))
    runs = again.withColumn("new", new).withColumn("run", F.sum("new").over(own))
    passages = runs.groupBy("doc_id", "body", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop"), F.sum("words").alias("words"))
    spans = F.sort_array(F.collect_list(F.struct("start", "stop")))
    return passages.where(F.col("words") >= min_words).groupBy("doc_id", "body").agg(spans.alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8, fine: bool = False) -> DataFrame:
    """``(doc_id, n_chars, n_spans, removed_chars, spans, text)``, one row per row of ``docs``.

    ``spans`` lists what was removed as ``start-stop`` in code points of the
    original text, comma-separated, in order; ``text`` is the rest.  The
    earliest occurrence of every passage stays, also within one document.  Null
    and empty texts come back empty with no span; rows with the same doc_id and
    text are one occurrence, so they keep or lose the same passages.  Other
    columns are not read; an empty table gives an empty one.  ``fine`` also
    finds passages inside a line that hold no whole sentence, see ``FINE``.
    """

    def body(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for ids, texts in slices(batch, SLICE, "doc_id", "text"):
                found = [xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts), pa.array(found, pa.int64())], ["doc_id", "text", "body"])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for ids, spans, texts in slices(batch, SLICE, "doc_id", "spans", "text"):
                rest = []
                for text, gone in zip(texts, spans):
                    edges = [0, *(x for s in gone or () for x in (s["start"], s["stop"])), len(text)]
                    rest.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                arrays = [
                    pa.array(ids, pa.int64()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([len(s or ()) for s in spans], pa.int64()),
                    pa.array([sum(x["stop"] - x["start"] for x in s or ()) for s in spans], pa.int64()),
                    pa.array([",".join(f"{x['start']}-{x['stop']}" for x in s or ()) for s in spans]),
                    pa.array(rest),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "n_spans", "removed_chars", "spans", "text"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(rows, min_words, fine).withColumnsRenamed({"doc_id": "other_id", "body": "other"})
    hashed = rows.mapInArrow(body, "doc_id long, text string, body long")
    joined = hashed.join(spans, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("body") == F.col("other")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_chars long, n_spans long, removed_chars long, spans string, text string")
