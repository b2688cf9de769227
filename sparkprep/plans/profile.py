"""The profile of a table: table totals, column statistics, distributions.

Whole-table passes only, each shared by all columns: one aggregate for counts
and moments, short passes for the exact medians, one for the
histograms, one for distinct and top values, and one for duplicate rows.
"""

from __future__ import annotations

from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import (
    FLOATING,
    INTEGRAL,
    TIMES,
    TIMESTAMP_TEXT,
    col,
    is_infinite,
    is_numeric,
    number_of,
    text_of,
    value_of,
)
from sparkprep.functions.duplicates import count_duplicates
from sparkprep.functions.lookup import Kept, fits_broadcast
from sparkprep.functions.quantiles import Quantiles
from sparkprep.operators.numeric import even_bin, evenly_spaced

HISTOGRAM_BINS = 10
TOP_VALUES = 20
WHOLE_REALS = 2.0**45  # below it, hundredths of a real are exact whole numbers
HEAD = 48  # characters of a text that are counted as they are

TABLE_SCHEMA = (
    "total_rows long, total_cols int, logical_bytes long, duplicate_rows long, missing_cells long, clean boolean"
)
COLUMN_SCHEMA = (
    "position int, name string, type string, missing long, missing_pct double, valid_pct double, unique long, "
    "mean double, median double, std_dev double, min double, max double, top_value string, freq long, "
    "high_missing boolean, warn_missing boolean, has_missing boolean, truncated boolean, "
    "distribution array<struct<label:string,value:long>>"
)


def _bytes(df: DataFrame, field: T.StructField) -> Column:
    """Logical size: 8 bytes per number or time, 1 per flag, the text's length."""
    if isinstance(field.dataType, T.BooleanType):
        return F.count(F.lit(1))
    if is_numeric(field.dataType) or isinstance(field.dataType, TIMES):
        return F.count(F.lit(1)) * 8
    return F.coalesce(F.sum(F.octet_length(text_of(df, field.name))), F.lit(0))


def _unpivoted(df: DataFrame, cells: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*cells)))


def _families(df: DataFrame) -> dict[str, list[tuple[int, Column]]]:
    """Columns by the type their values are counted in, so each keeps its exact
    type; times count as microseconds, other numbers as text."""
    families: dict[str, list[tuple[int, Column]]] = {}
    for i, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, INTEGRAL):
            kind, value = "whole", col(field.name).cast("long")
        elif isinstance(field.dataType, FLOATING):
            kind, value = "real", number_of(df, field.name)
        elif isinstance(field.dataType, TIMES):
            kind, value = "time", F.unix_micros(col(field.name).cast("timestamp"))
        else:
            kind, value = "number" if is_numeric(field.dataType) else "text", text_of(df, field.name)
        families.setdefault(kind, []).append((i, value))
    return families


def value_counts(df: DataFrame) -> dict[str, DataFrame]:
    """How often each non-null value of each column occurs, one frame per family of
    types: ``i, v, n``, and for texts ``i, v, h1, h2, size, n``.

    Each frame scans its own columns only and counts on the map side first, so
    hot values cost nothing.  A long text is counted by its first characters,
    length and a 128-bit hash: texts themselves are not shuffled.
    """
    frames = {}
    for kind, family in _families(df).items():
        values = _unpivoted(df, [F.struct(F.lit(i).alias("i"), value.alias("v")) for i, value in family]).where("v is not null")
        keys = ["i", "v"]
        if kind == "text":
            values, keys = values.select("i", *_text_key(F.col("v"))), ["i", "v", "h1", "h2", "size"]
        frames[kind] = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return frames


def _text_key(text: Column) -> list[Column]:
    """A text of up to ``HEAD`` characters as it is; the head, hash and length of a longer one."""
    long = F.length(text) > HEAD
    hashes = [F.when(long, F.xxhash64(F.lit(k), text)).alias(f"h{k}") for k in (1, 2)]
    return [F.substring(text, 1, HEAD).alias("v"), *hashes, F.when(long, F.length(text)).alias("size")]


def distinct_words(df: DataFrame, kind: str, family: list[tuple[int, Column]]) -> DataFrame:
    """The different numbers of each column, 64 neighbours to a word: ``i, w, bits``.

    Keys and codes lie close together, so a task sends one word for up to 64 of
    them; where they lie apart, a word holds one number and costs no more than the
    number would.  Reals that are whole hundredths (prices, rates) count as these;
    others, under the column's own number instead of one past all columns, keep
    their value as the key.
    """
    cells = [F.struct(F.lit(i).alias("i"), value.alias("v")) for i, value in family]
    values = _unpivoted(df, cells).where("v is not null")
    v, i = F.col("v"), F.col("i")
    if kind == "whole":
        return _words(values.select(i, F.shiftright(v, 6).alias("w"), _bit(v).alias("bit")))
    hundredths = F.rint(v * 100)
    exact = (F.abs(v) < WHOLE_REALS) & (hundredths / 100 == v)
    whole = F.when(exact, hundredths).try_cast("long")
    return _words(
        values.select(
            F.when(exact, i + len(df.columns)).otherwise(i).alias("i"),
            F.when(exact, F.shiftright(whole, 6).cast("double")).otherwise(v).alias("w"),
            F.when(exact, _bit(whole)).otherwise(F.lit(1).cast("long")).alias("bit"),
        )
    )


def _bit(whole: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), whole.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def _words(values: DataFrame) -> DataFrame:
    return values.groupBy("i", "w").agg(F.bit_or("bit").alias("bits"))


def _top(counts: DataFrame) -> DataFrame:
    """The most frequent values per column, smaller ones first among equals: ``i, place, v, n``.
    The window keeps 20 rows per column and task before anything is shuffled."""
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
    return counts.select("i", "v", "n", place.alias("place")).where(F.col("place") <= TOP_VALUES)


def _top_texts(df: DataFrame, family: list[tuple[int, Column]], counts: DataFrame, kept: Kept) -> DataFrame:
    """The same for texts.  The order by count and head leaves the first twenty and
    what ties with the last of them; only these are looked up in the table again."""
    place = F.rank().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
    first = kept.keep(counts.withColumn("place", place).where(F.col("place") <= TOP_VALUES).drop("place"))
    cut = first.where("h1 is not null").select("i", "h1", "h2", "size", "n")
    if cut.isEmpty():
        return _top(first)
    cells = [F.struct(F.lit(i).alias("i"), value.alias("text")) for i, value in family]
    key = ["i", "h1", "h2", "size"]
    rows = _unpivoted(df, cells).where(F.length("text") > HEAD).select("i", "text", *_text_key(F.col("text"))[1:])
    found = rows.join(F.broadcast(cut) if fits_broadcast(cut) else cut, key)
    whole = found.groupBy(*key).agg(F.first("text").alias("v"), F.first("n").alias("n"))
    return _top(first.where("h1 is null").select("i", "v", "n").unionByName(whole.select("i", "v", "n")))


def _distinct_and_top(df: DataFrame) -> tuple[dict[int, int], dict[int, list[tuple[str, int]]]]:
    """Distinct values per column, and the top values of categorical columns."""
    parts, kept = [], Kept()
    families, frames = _families(df), value_counts(df)
    for kind in ("whole", "real"):
        if kind in frames:
            del frames[kind]
            words = distinct_words(df, kind, families[kind])
            unique = words.groupBy((F.col("i") % len(df.columns)).alias("i")).agg(F.sum(F.bit_count("bits")).alias("n"))
            parts.append(unique.select("i", F.lit(0).alias("place"), F.lit(None).cast("string").alias("label"), "n"))
    for kind, counts in frames.items():
        topped = kind in ("time", "text")
        if kind == "text":
            counts = kept.keep(counts)  # read once for the numbers, once for the top
        # Reading n in both branches keeps their shuffles alike, so one is reused.
        groups = F.count_if(F.col("n") > 0) if topped else F.count(F.lit(1))
        unique = counts.groupBy("i").agg(groups.alias("n"))
        parts.append(unique.select("i", F.lit(0).alias("place"), F.lit(None).cast("string").alias("label"), "n"))
        if topped:
            label = F.date_format(F.timestamp_micros("v"), TIMESTAMP_TEXT) if kind == "time" else F.col("v")
            top = _top_texts(df, families["text"], counts, kept) if kind == "text" else _top(counts)
            parts.append(top.select("i", "place", label.alias("label"), "n"))
    rows = reduce(DataFrame.unionByName, parts).collect()
    kept.release()
    distinct = {r["i"]: r["n"] for r in rows if r["place"] == 0}
    tops: dict[int, list[tuple[str, int]]] = {}
    for r in sorted((r for r in rows if r["place"]), key=lambda r: r["place"]):
        tops.setdefault(r["i"], []).append((r["label"], r["n"]))
    return distinct, tops


def histogram_edges(low: float, high: float) -> list[float]:
    return evenly_spaced(low - 0.5, high + 0.5, HISTOGRAM_BINS) if low == high else evenly_spaced(low, high, HISTOGRAM_BINS)


def _histograms(df: DataFrame, edges: dict[int, list[float]]) -> dict[int, list[tuple[str, int]]]:
    """Equal-width bins closed on the left, the last one on both sides."""
    if not edges:
        return {}
    names = df.columns
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            number_of(df, names[i]).alias("x"),
            F.lit(e[0]).alias("low"),
            F.lit((e[-1] - e[0]) / HISTOGRAM_BINS).alias("width"),
        )
        for i, e in edges.items()
    ]
    # The bin is computed after the columns became rows: one short expression
    # instead of one per column keeps the generated code small enough to compile.
    bin_ = even_bin(F.col("x"), F.col("low"), F.col("width"), HISTOGRAM_BINS, "left")
    values = _unpivoted(df, cells).where("x is not null").select("i", bin_.alias("bin"))
    rows = values.groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {(r["i"], r["bin"]): r["n"] for r in rows}
    return {
        i: [(f"{e[b]:.1f}-{e[b + 1]:.1f}", seen.get((i, b), 0)) for b in range(HISTOGRAM_BINS)] for i, e in edges.items()
    }


def _rounded(value: float | None, digits: int = 2) -> float | None:
    return None if value is None else round(float(value), digits)


class Profile:
    """Statistics of one table; each part runs its passes when first asked for."""

    def __init__(self, df: DataFrame, approximate_unique: bool = False):
        self.df = df
        self.approximate_unique = approximate_unique
        self.fields = df.schema.fields
        self.numeric = {i: f.name for i, f in enumerate(self.fields) if is_numeric(f.dataType)}
        self._search = Quantiles(
            {str(i): number_of(df, n) for i, n in self.numeric.items()}, {str(i): [0.5] for i in self.numeric}
        )

    @cached_property
    def _totals(self) -> Row:
        df = self.df
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, field in enumerate(self.fields):
            value = value_of(df, field.name)
            aggs += [F.count(value).alias(f"n{i}"), _bytes(df, field).alias(f"b{i}")]
            if self.approximate_unique:
                aggs.append(F.approx_count_distinct(value).alias(f"u{i}"))
            if i in self.numeric:
                x = number_of(df, field.name)
                aggs += [
                    F.avg(x).alias(f"avg{i}"),
                    F.stddev_samp(x).alias(f"std{i}"),
                    F.min(x).alias(f"min{i}"),
                    F.max(x).alias(f"max{i}"),
                    F.count_if(is_infinite(x)).alias(f"inf{i}"),
                ]
        return df.agg(*aggs, *self._search.counts()).first()

    @cached_property
    def _medians(self) -> dict[int, float | None]:
        found = self._search.resolve(self.df, self._totals)
        return {i: found[str(i)][0.5] for i in self.numeric}

    @cached_property
    def _bars(self) -> dict[int, list[tuple[str, int]]]:
        row = self._totals
        edges = {
            i: histogram_edges(row[f"min{i}"], row[f"max{i}"])
            for i in self.numeric
            if row[f"n{i}"] and not row[f"inf{i}"]
        }
        # A range too narrow for ten different edges has no histogram.
        return _histograms(self.df, {i: e for i, e in edges.items() if e[1] > e[0]})

    @cached_property
    def _values(self) -> tuple[dict[int, int], dict[int, list[tuple[str, int]]]]:
        """Distinct counts of all columns and top values of categorical ones."""
        if not self.approximate_unique:
            return _distinct_and_top(self.df) if self.fields else ({}, {})
        unique = {i: self._totals[f"u{i}"] for i in range(len(self.fields))}
        others = [i for i in range(len(self.fields)) if i not in self.numeric]
        if not others:
            return unique, {}
        tops = _distinct_and_top(self.df.select(*[col(self.fields[i].name) for i in others]))[1]
        return unique, {others[j]: top for j, top in tops.items()}

    @cached_property
    def table(self) -> DataFrame:
        """One row of table totals."""
        row, n = self._totals, len(self.fields)
        rows = row["rows"]
        size = sum(row[f"b{i}"] for i in range(n))
        missing = sum(rows - row[f"n{i}"] for i in range(n))
        duplicates = count_duplicates(self.df) if rows and n else 0
        return self.df.sparkSession.createDataFrame(
            [(rows, n, size, duplicates, missing, duplicates == 0)], TABLE_SCHEMA
        )

    @cached_property
    def columns(self) -> DataFrame:
        """One row per column."""
        rows = [self._column(i, f.name) for i, f in enumerate(self.fields)]
        return self.df.sparkSession.createDataFrame(rows, COLUMN_SCHEMA)

    def _column(self, i: int, name: str) -> tuple[Any, ...]:
        row, numeric = self._totals, i in self.numeric
        rows, known = row["rows"], row[f"n{i}"]
        pct = round((rows - known) / rows * 100, 1) if rows else None
        unique, tops = self._values
        distinct, top = unique.get(i, 0), tops.get(i, [])
        stats = [None] * 5
        if numeric:
            stats = [row[f"avg{i}"], self._medians[i], row[f"std{i}"], row[f"min{i}"], row[f"max{i}"]]
        return (
            i,
            name,
            "numeric" if numeric else "categorical",
            rows - known,
            pct,
            None if pct is None else round(100 - pct, 1),
            distinct,
            *[_rounded(v) for v in stats],
            *(top[0] if top else (None, None)),
            pct is not None and pct > 50,
            pct is not None and pct > 20,
            pct is not None and pct > 0,
            not numeric and distinct > TOP_VALUES,
            self._bars.get(i, []) if numeric else top,
        )

    def select(self, kind: str = "All", search: str = "") -> DataFrame:
        """Column rows of one kind (All, Numeric, Categorical, Missing) whose name
        contains ``search``, ignoring case."""
        rows = self.columns.where(F.lower("name").contains(search.lower()))
        if kind in ("Numeric", "Categorical"):
            return rows.where(F.col("type") == kind.lower())
        return rows.where(F.col("missing_pct") > 0) if kind == "Missing" else rows

    def distributions(self) -> DataFrame:
        """One row per bar: ``name, place, label, value``."""
        bars = self.columns.select("name", F.posexplode("distribution").alias("place", "bar"))
        return bars.select("name", "place", "bar.label", "bar.value")


def profile(df: DataFrame, approximate_unique: bool = False) -> Profile:
    """Statistics of the whole table.

    ``approximate_unique`` replaces the exact distinct counts, whose shuffle
    carries every distinct value, by a sketch in the first pass.
    """
    return Profile(df, approximate_unique)
