"""Ranked lexical search: accumulators term at a time, the rarest term first, over an index cut into slices of documents.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lowered.  A document scores the sum over the query's terms, repeats included, of
``w * (1000000000 * tf div (1000 * tf + 8 * m))`` with ``w = floor(1000 *
ln((2N + 2) / (2df + 1)))`` and ``m = 25 + 75 * n * N div L``: N documents hold a
term, L terms stand in all of them, n in this one, df documents hold the term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import col, kept, slices, union_all

SLICE = 2 << 20  # bytes of text in a row of the index
QUERY_BYTES = 4 << 20  # bytes of query text searched in one pass
INDEX = "doc_ids binary, nulls binary, sizes binary, n_docs long, n_terms long, terms string, starts binary, docs binary, tfs binary"


def split_terms(texts: list[str]):
    """Terms of all texts in one Arrow array, and where the terms of each text end."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = np.arange(256, dtype=np.uint8)
    table[:128] = [c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)]
    given = pa.array(texts, pa.large_string())
    if not len(given):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    _, offsets, data = given.buffers()
    plain = pa.py_buffer(table[np.frombuffer(data, np.uint8)].tobytes()) if data else data
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(given), offsets, plain))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), seen[np.cumsum(counts, dtype=np.int64)]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index, one row per slice of documents: term after term the documents that hold it, with their counts.

    Every row of ``docs`` has its place in it, a null or empty text without
    terms.  Written once to the shared folder; any number of searches read it.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = [part.split()[0] for part in INDEX.split(", ")]
        for batch in batches:
            for ids, texts in slices(batch, SLICE, "doc_id", "text"):
                found, ends = split_terms(texts)
                coded = found.dictionary_encode()
                sizes = np.diff(ends, prepend=0)
                places = np.repeat(np.arange(len(ids)), sizes)
                which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                codes, tfs = np.unique(which * len(ids) + places, return_counts=True)
                starts = np.searchsorted(codes // len(ids), np.arange(len(coded.dictionary) + 1))
                cells = [
                    np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], "?").tobytes(), sizes.astype("<i8").tobytes(),
                    int((sizes > 0).sum()), int(sizes.sum()), " ".join(coded.dictionary.to_pylist()),
                    starts.astype("<i8").tobytes(), (codes % len(ids)).astype("<i4").tobytes(), tfs.astype("<i4").tobytes(),
                ]
                kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names)

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return kept(rows.mapInArrow(run, INDEX))


class Accumulators:
    """Scores of a slice's documents for one query after the other; keeps each query's best ``k`` over all slices seen."""

    def __init__(self, queries: list[dict], terms: int, k: int):
        self.queries, self.terms, self.k = queries, terms, k
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, id is null, id), ascending

    def add(self, ids, nulls, starts, stops, docs, impacts) -> None:
        """Search one slice: the postings of query term ``q`` are ``docs[starts[q]:stops[q]]`` with ``impacts``."""
        import numpy as np

        top = np.zeros(self.terms, np.int64)
        held = np.flatnonzero(stops > starts)
        if not len(held):
            return
        order = held[np.argsort(starts[held])]  # the chosen postings lie one after the other
        top[order] = np.maximum.reduceat(impacts, starts[order])
        for query, best in zip(self.queries, self.best):
            self._query(query, best, ids, nulls, starts, stops, docs, impacts, top)

    def _query(self, query, best, ids, nulls, starts, stops, docs, impacts, top) -> None:
        """Rarest term first.  While the bounds of the terms left could lift a new
        document to the k-th partial score, documents get accumulators; after
        that only those that have one are looked up in the remaining postings."""
        import numpy as np

        terms, factors, k = query["terms"], query["factors"], self.k
        bounds = factors * top[terms]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        goal = -best[-1][0] if len(best) == k else 0  # k documents have as much
        sums = np.zeros(len(ids), np.int64)
        chosen = None
        for j in np.flatnonzero(bounds).tolist():
            if chosen is None and rest[j] < goal:
                chosen = np.flatnonzero(sums)
                if not len(chosen):
                    return
            a, b = int(starts[terms[j]]), int(stops[terms[j]])
            if chosen is None:
                sums[docs[a:b]] += factors[j] * impacts[a:b]
                if len(sums) >= k and rest[j + 1] < sums.max():
                    goal = max(goal, int(np.partition(sums, -k)[-k]))
            else:
                at = a + np.searchsorted(docs[a:b], chosen)
                hit = at < b
                hit[hit] = docs[at[hit]] == chosen[hit]
                sums[chosen[hit]] += factors[j] * impacts[at[hit]]
        chosen = np.flatnonzero(sums >= max(goal, 1)) if chosen is None else chosen[sums[chosen] >= max(goal, 1)]
        if len(chosen) > k:
            chosen = chosen[sums[chosen] >= np.partition(sums[chosen], -k)[-k]]
        best += zip((-sums[chosen]).tolist(), nulls[chosen].tolist(), ids[chosen].tolist())
        best.sort()
        del best[k:]


def search(found: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above 0 for every row of ``items``.

    ``found`` comes from :func:`index`.  Equal scores rank by ascending id, null
    ids last.  Items without terms, and all items over an empty index, have no
    rows; a repeated item has its rows once for each time.  Items are searched in
    blocks of about ``QUERY_BYTES``; a block's terms and their frequencies, a
    few times that much, go to all tasks.  A task scores its own slices, where
    only global counts enter, and hands over ``k`` rows per item.
    """
    spark = found.sparkSession
    n, total = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = items.select(col(item_col).cast("long").alias("item_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES + 1
    answers = [_block(found, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), b, n, total, k) for b in range(blocks if n else 0)]
    if not answers:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = union_all(answers).withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(found: DataFrame, asked: list, block: int, n: int, total: int, k: int) -> DataFrame:
    """The best of every task for one block of items."""
    texts = [r["text"] for r in asked]
    words, ends = split_terms(texts)
    coded = words.dictionary_encode()
    vocabulary, which = coded.dictionary, coded.indices.to_pylist()

    def chosen(row: dict):
        """Which query term each term of a slice is, -1 for none."""
        import pyarrow as pa
        import pyarrow.compute as pc

        terms = pc.ascii_split_whitespace(pa.array([row["terms"]] if row["terms"] else [], pa.large_string())).flatten()
        return pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)

    def frequencies(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                place = chosen(row)
                lengths = np.diff(np.frombuffer(row["starts"], "<i8"))
                df[place[place >= 0]] += lengths[place >= 0]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    counted = found.select("terms", "starts").mapInArrow(frequencies, "term long, df long")
    df = {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    queries, begin = [], 0
    for end in ends.tolist():
        times = Counter(t for t in which[begin:end] if t in df)
        terms = sorted(times, key=lambda t: (df[t], t))
        queries.append((terms, [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * times[t] for t in terms]))
        begin = end
    names = [r["item_id"] for r in asked]

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        work = Accumulators([{"terms": np.array(t, np.int64), "factors": np.array(f, np.int64)} for t, f in queries], len(vocabulary), k)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                place = chosen(row)
                offsets, sizes = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["sizes"], "<i8")
                held = np.flatnonzero(place >= 0)
                lengths = np.diff(offsets)[held]
                stops = np.cumsum(lengths)
                picked = np.arange(int(lengths.sum())) + np.repeat(offsets[held] - (stops - lengths), lengths)
                docs, tfs = np.frombuffer(row["docs"], "<i4")[picked], np.frombuffer(row["tfs"], "<i4")[picked].astype(np.int64)
                m = 25 + 75 * sizes * n // total
                first, last = np.zeros((2, len(vocabulary)), np.int64)
                first[place[held]], last[place[held]] = stops - lengths, stops
                ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], "?")
                work.add(ids, nulls, first, last, docs, 1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
        rows = [(i, names[i], None if null else doc, -score) for i, best in enumerate(work.best) for score, null, doc in best]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "item_id", "doc_id", "score"])

    return found.mapInArrow(score, "item long, item_id long, doc_id long, score long").withColumn("block", F.lit(block))
