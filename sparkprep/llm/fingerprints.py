"""Document fingerprints by a homomorphic multiset hash of paragraphs, in SQL expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import col

#: Lanes of a paragraph's vector, numbers of ``BITS`` bits; they add up modulo 2 ** BITS.
LANES, BITS = 16, 30
HALF = (1 << BITS) - 1
#: Sums of the sketch: two lanes of hash bits each, 30 bits apart.
SIGNS = 60
PAIR = 1 | 1 << BITS
ROWS_PER_RANGE, SAMPLE = 512, 8
FIRST = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """The lines of a text that are not empty."""
    return F.filter(F.split(text, "\n"), lambda u: u != "")


def sentences(text: Column) -> Column:
    """The lines, cut further after sentences: the units whose share the sketch estimates."""
    return paragraphs(F.replace(text, F.lit(". "), F.lit(".\n")))


def units(text: Column) -> Column:
    """Array of ``(u, whole)``: paragraphs, then sentences."""
    whole = F.transform(paragraphs(text), lambda u: F.struct(u.alias("u"), F.lit(True).alias("whole")))
    parts = F.transform(sentences(text), lambda u: F.struct(u.alias("u"), F.lit(False).alias("whole")))
    return F.concat(whole, parts)


def words_of(unit: Column, whole: Column) -> list[Column]:
    """A unit's hash in words of 60 bits: eight of two SHA-256 for a paragraph, then two of MD5 for a sentence; null for the other kind."""
    word = lambda digest, k: F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")
    wide = [F.sha2(F.concat(F.lit(mark), unit).cast("binary"), 256) for mark in "ab"]
    return [F.when(whole, word(wide[k // 4], k % 4)) for k in range(8)] + [F.when(~whole, word(F.md5(unit.cast("binary")), k)) for k in range(2)]


def vector_sums() -> list[Column]:
    """Aggregates over the columns ``w0`` to ``w9`` of units: the fingerprint of their multiset.

    First the hash: 16 lanes of 30 bits, each the sum over the paragraphs of a
    lane of their hash, modulo 2^30.  Then the sketch: 120 lanes, each the sum over
    the sentences of a hash bit, two lanes to a number, modulo 2^30 as well, and
    the number of sentences.  Sums commute, so order does not matter, and adding
    or subtracting a unit's own vector inserts or deletes it.
    """
    lanes = [F.sum(F.shiftright(f"w{k // 2}", BITS * (k % 2)).bitwiseAND(F.lit(HALF))) for k in range(LANES)]
    signs = [F.sum(F.shiftright(f"w{8 + k}", s).bitwiseAND(F.lit(PAIR))) for k in range(2) for s in range(BITS)]
    return [F.coalesce(c, F.lit(0).cast("long")) for c in [*lanes, *signs, F.count("w8")]]


def modulo(vector: Column) -> Column:
    """Every lane reduced to its ``BITS`` bits; both lanes of a number of the sketch."""

    def reduced(x: Column, i: Column) -> Column:
        low = x.bitwiseAND(F.lit(HALF))
        high = F.shiftright(x, BITS).bitwiseAND(F.lit(HALF))
        return F.when((i < LANES) | (i == LANES + SIGNS), low).otherwise(F.shiftleft(high, BITS) + low)

    return F.transform(vector, reduced)


def to_text(vector: Column) -> Column:
    """Lowercase hex digits: 8 for each lane of the hash, 15 for each number of the sketch."""
    return F.lower(F.array_join(F.transform(vector, lambda x, i: F.lpad(F.hex(x), F.when(i < LANES, 8).otherwise(15), F.lit("0"))), ""))


def signed_lanes(vector: Column) -> Column:
    """Twice the ones less the sentences, per lane of the sketch: sums of random signs."""
    count, sums = F.element_at(vector, -1), F.slice(vector, LANES + 1, SIGNS)
    low = F.transform(sums, lambda x: x.bitwiseAND(F.lit(HALF)) * 2 - count)
    high = F.transform(sums, lambda x: F.shiftright(x, BITS).bitwiseAND(F.lit(HALF)) * 2 - count)
    return F.concat(low, high)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of common sentences, 0 to 1: twice the inner product over the squared lengths; 1 for equal vectors."""
    near = F.lit(2.0) * dot(a, b) / (dot(a, a) + dot(b, b))
    return F.when(same, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(near, F.lit(0.0)))))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_units, vector array<long>)``: one fingerprint per doc_id, of ``n_units`` paragraphs.

    Vectors of disjoint sets of units add: ``insert`` and ``delete`` update one
    without the old text.  Null and empty texts have the zero vector; rows that
    share a doc_id are fingerprinted together, as one multiset: they are added up
    with map-side combine, so an id with very many rows is no hot key.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.explode_outer(units(F.coalesce(col(text_col).cast("string"), F.lit("")))).alias("x"))
    rows = rows.select("doc_id", *[w.alias(f"w{k}") for k, w in enumerate(words_of(F.col("x.u"), F.col("x.whole")))])
    sums = vector_sums()
    found = rows.groupBy("doc_id").agg(F.count("w0").alias("n_units"), *[c.alias(f"s{i}") for i, c in enumerate(sums)])
    return found.select("doc_id", "n_units", modulo(F.array(*[f"s{i}" for i in range(len(sums))])).alias("vector"))


def insert(vector: Column, other: Column) -> Column:
    """The fingerprint of both multisets together."""

    def more(x: Column, y: Column) -> Column:
        low = (x.bitwiseAND(F.lit(HALF)) + y.bitwiseAND(F.lit(HALF))).bitwiseAND(F.lit(HALF))
        high = (F.shiftright(x, BITS) + F.shiftright(y, BITS)).bitwiseAND(F.lit(HALF))
        return F.shiftleft(high, BITS) + low

    return F.zip_with(vector, other, more)


def delete(vector: Column, other: Column) -> Column:
    """The fingerprint without the units of ``other``, which it must hold."""

    def less(x: Column, y: Column) -> Column:  # the low lane first, so that it borrows nothing of the high one
        low = (x.bitwiseAND(F.lit(HALF)) - y.bitwiseAND(F.lit(HALF))).bitwiseAND(F.lit(HALF))
        high = (F.shiftright(x, BITS) - F.shiftright(y, BITS)).bitwiseAND(F.lit(HALF))
        return F.shiftleft(high, BITS) + low

    return F.zip_with(vector, other, less)


def with_next(docs: DataFrame) -> DataFrame:
    """``(part, place, doc_id, text, next)``: each document with the text of the next by ascending doc_id.

    A null doc_id comes first; equal ones are ordered by a hash of their texts, so
    that an id of very many rows is cut too; after the last comes the first.
    Rows go to ranges of 512 or, in large tables, of the root of their number;
    the bounds come from the rows with the smallest hash.  Every range also
    receives the first document of the one behind it, so no window spans the table.
    """
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(FIRST)).alias("at"), F.xxhash64("text").alias("h"))
    total = rows.count()
    ranges = total // max(ROWS_PER_RANGE, math.isqrt(total)) + 1
    bounds: list = []
    if ranges > 1:
        picked = rows.select("at", "h").orderBy(F.xxhash64("at", "h"), "at", "h").limit(SAMPLE * ranges).collect()
        keys = sorted((r["at"], r["h"]) for r in picked)
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    part = F.lit(0)
    if bounds:
        ids, hashes = (F.lit([b[k] for b in bounds]) for k in (0, 1))
        steps = F.lit([1 << i for i in reversed(range(len(bounds).bit_length()))])

        def passed(at: Column, step: Column) -> Column:
            bound, tie = F.get(ids, at + step - 1), F.get(hashes, at + step - 1)
            return (at + step <= len(bounds)) & ((bound < F.col("at")) | ((bound == F.col("at")) & (tie <= F.col("h"))))

        part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at, step), at + step).otherwise(at))
    rows = rows.withColumn("part", part)
    heads = sorted((r["part"], r["first"]["at"], r["first"]["h"]) for r in rows.groupBy("part").agg(F.min(F.struct("at", "h")).alias("first")).collect())
    before = [(at, h, heads[i - 1][0]) for i, (_, at, h) in enumerate(heads)]
    to = docs.sparkSession.createDataFrame(before, "at long, h long, part int")  # a row per range
    same = rows.drop("part").join(F.broadcast(to), ["at", "h"])
    ghosts = same.groupBy("at", "h", "part").agg(F.min("text").alias("text")).select(F.col("at").alias("doc_id"), "text", "at", "h", "part", F.lit(1).alias("ghost"))
    order = Window.partitionBy("part").orderBy("ghost", "at", "h", "text")
    both = rows.select("doc_id", "text", "at", "h", "part", F.lit(0).alias("ghost")).union(ghosts)
    found = both.select("doc_id", "text", "part", "ghost", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    return found.where("ghost = 0").drop("ghost")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, one row per row of ``docs``.

    The edited text has the last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document's.  Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Null texts count as empty; empty texts share the zero fingerprint and are
    alike by 1 with each other and by 0 with others.  Equal texts, and texts
    that differ only in the order of paragraphs or in empty lines, have equal
    fingerprints.  An empty table gives an empty one; other columns are not read.
    """
    rows = with_next(docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    own = ["part", "place", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.select(
        "part", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array(*[units(F.col(c)) for c in ("text", "edited", "next")]).alias("texts"),
    )
    cut = rows.select(*own, F.posexplode("texts").alias("which", "units")).select(*own, "which", F.explode_outer("units").alias("x"))
    cut = cut.select(*own, "which", *[w.alias(f"w{k}") for k, w in enumerate(words_of(F.col("x.u"), F.col("x.whole")))])
    sums = vector_sums()
    vectors = cut.groupBy(*own, "which").agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)])
    vectors = vectors.select(*own, F.struct("which", modulo(F.array(*[f"s{i}" for i in range(len(sums))])).alias("v")).alias("x"))
    three = vectors.groupBy(*own).agg(F.sort_array(F.collect_list("x")).alias("x"))
    three = three.select("doc_id", "n_chars", "edited_sha256", *[F.col("x")[i]["v"].alias(n) for i, n in enumerate(("a", "b", "c"))])
    three = three.select("*", *[to_text(F.col(n)).alias(f"{n}_text") for n in "abc"], *[signed_lanes(F.col(n)).alias(f"{n}_lanes") for n in "abc"])
    near = [likeness(F.col("a_lanes"), F.col(f"{n}_lanes"), F.col("a_text") == F.col(f"{n}_text")) for n in "bc"]
    return three.select(
        "doc_id", "n_chars", "edited_sha256", F.col("a_text").alias("fingerprint"), F.col("b_text").alias("edited_fingerprint"),
        near[0].alias("near_edited"), near[1].alias("near_next"),
    )
