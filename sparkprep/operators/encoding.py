"""Turning categories into columns, codes or target means."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import col, is_numeric, number_of, text_of, type_of, value_of
from sparkprep.functions.lookup import fits_broadcast, lookup_join
from sparkprep.functions.ranks import running_start
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform

# Defaults of the smoothed target encoding.
MIN_SAMPLES_LEAF = 20
SMOOTHING = 10.0

DENSE_COLUMNS = 1_200  # columns that one step adds at most by itself
DENSE_BYTES = 16 << 20  # of the values in their names


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, v, n)``: distinct non-null values of like-typed columns, by place in ``columns``, with their rows; one pass."""
    cells = [F.struct(F.lit(i).alias("i"), value_of(df, c).alias("v")) for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*cells))).where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))


def dummy_columns(t: DataFrame, chosen: dict[str, list[Any]]) -> DataFrame:
    """Replace each column by one boolean per value, appended at the end; a
    missing value is false everywhere."""
    others = [col(c) for c in t.columns if c not in chosen]
    flags = [
        F.coalesce(value_of(t, c) == F.lit(v).cast(type_of(t, c)), F.lit(False)).alias(f"{c}_{v}")
        for c, values in chosen.items()
        for v in values
    ]
    return t.select(*others, *flags)


def learn_dummies(table: DataFrame, columns: list[str], fit: Fit, out: str, drop_first: bool, form: str, limit: int | None) -> Transform:
    """Replaces ``columns`` by one boolean per value, or by one array of value codes.

    The distinct values are counted first; only when they are few enough to be
    columns (``limit``, else ``DENSE_COLUMNS`` with names up to ``DENSE_BYTES``)
    do they come to the driver.  Otherwise they get their numbers on Spark, in
    the order the columns would have, and ``out`` holds the sorted numbers of a
    row's values.  ``fit.tables[out]`` then says which value a number stands for.
    """
    if form not in ("auto", "columns", "codes"):
        raise SkipStep(f"unknown form '{form}'")
    counts = fit.kept.keep(fit.table("counts", lambda: category_counts(table, columns)))
    sizes = {r["i"]: r for r in counts.groupBy("i").agg(F.count(F.lit(1)).alias("values"), F.sum(F.octet_length(F.col("v").cast("string"))).alias("bytes")).collect()}
    widths = [max(sizes[i]["values"] - drop_first, 0) if i in sizes else 0 for i in range(len(columns))]
    longest = max((c for c in range(len(columns))), key=widths.__getitem__, default=0)
    if limit is not None and form != "codes" and widths and widths[longest] + drop_first > limit:
        raise SkipStep(f"column '{columns[longest]}' has more than {limit} categories; raise max_columns to widen the table")
    fits = sum(widths) <= max(DENSE_COLUMNS, limit or 0) and sum(r["bytes"] for r in sizes.values()) <= DENSE_BYTES
    if form == "columns" and not fits:
        raise SkipStep(f"{sum(widths)} categories are too many for columns; use form 'codes'")
    if fits and form != "codes":
        chosen: dict[str, list[Any]] = {c: [] for c in columns}
        for r in counts.orderBy("i", "v").collect():
            chosen[columns[r["i"]]].append(r["v"])
        wanted = {c: values[int(drop_first) :] for c, values in chosen.items()}
        return lambda t: dummy_columns(t, wanted)

    while out in table.columns:
        out += "_"
    lookups, parts, begin = [], [], 0
    for i, c in enumerate(columns):
        if not widths[i]:
            continue
        ranked = running_start(counts.where(F.col("i") == i).select("v", "n"), "v", F.lit(1), rows=sizes[i]["values"])
        code = F.col("start") - int(drop_first) + begin
        lookup = fit.kept.keep(ranked.where(F.col("start") >= int(drop_first)).select("v", F.col("n").alias("__cn"), code.alias(f"__code{i}")))
        small = fits_broadcast(lookup)
        fit.shuffled |= not small
        lookups.append((c, lookup, f"__code{i}", small))
        value = F.col("v").cast("string")
        parts.append(lookup.select(F.col(f"__code{i}").alias("code"), F.lit(c).alias("column"), value.alias("value"), F.col("__cn").alias("rows")))
        begin += widths[i]
    empty = table.sparkSession.createDataFrame([], "code long, column string, value string, rows long")
    fit.tables[out] = reduce(DataFrame.unionAll, parts, empty)

    def transform(t: DataFrame) -> DataFrame:
        for c, lookup, name, small in lookups:
            t = lookup_join(t, lookup, {"v": value_of(t, c)}, "__cn", fit.kept, small=small).drop("__cn")
        codes = F.array_compact(F.array(*[F.col(name) for _, _, name, _ in lookups])) if lookups else F.array().cast("array<bigint>")
        others = [c for c in t.columns if c not in columns and c not in {x[2] for x in lookups}]
        return t.select(*[col(c) for c in others], codes.alias(out))

    return transform


def one_hot_encode(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """One boolean per value except the smallest; ``max_columns`` refuses wider ones.

    Beyond ``DENSE_COLUMNS`` values, or with ``form='codes'``, the array
    ``{column}_codes`` holds the number the value's column would have (from 0) and
    is empty for the smallest and for a missing value.  ``form='columns'`` refuses
    instead.
    """
    limit = int(params["max_columns"]) if params.get("max_columns") is not None else None

    def learn(table: DataFrame, fit: Fit) -> Transform:
        return learn_dummies(table, [column], fit, f"{column}_codes", True, params.get("form") or "auto", limit)

    # The new names are known only after fitting, so nothing may share the pass.
    return StepPlan(learn, {column}, {column}, whole_row=True)


def auto_dummies(df: DataFrame, fit: Fit, limit: int | None = None, form: str = "auto") -> DataFrame:
    """One boolean per value of every remaining text column, none dropped; too
    many values become the numbers in the array ``dummy_codes``."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return learn_dummies(df, names, fit, "dummy_codes", False, form, limit)(df) if names else df


def _codes(table: DataFrame, value: Column, fit: Fit) -> DataFrame:
    """Distinct values ``v`` with row count ``n`` and 0-based rank ``start``."""

    def codes() -> DataFrame:
        counts = table.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        return running_start(fit.kept.keep(counts), "v", F.lit(1))

    return fit.kept.keep(fit.table("codes", codes))


def _encode(column: str, codes: DataFrame, key, kind: str, fit: Fit) -> Transform:
    lookup = codes.select("v", F.col("n").alias("__cn"), F.col("start").cast(kind).alias("__code"))
    small = fits_broadcast(lookup)
    fit.shuffled = not small

    def transform(t: DataFrame) -> DataFrame:
        joined = lookup_join(t, lookup, {"v": key(t)}, "__cn", fit.kept, small=small)
        return joined.withColumn(column, F.col("__code")).drop("__cn", "__code")

    return transform


def label_encode(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Rank of the text form among the sorted distinct texts; missing values are
    the text ``nan``."""

    def key(t: DataFrame) -> Column:
        return F.coalesce(text_of(t, column), F.lit("nan"))

    def learn(table: DataFrame, fit: Fit) -> Transform:
        return _encode(column, _codes(table, key(table), fit), key, "long", fit)

    return StepPlan(learn, {column}, {column})


def ordinal_encode(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Rank among the sorted distinct values as a double; missing stays missing."""

    def learn(table: DataFrame, fit: Fit) -> Transform:
        codes = _codes(table, value_of(table, column), fit)
        return _encode(column, codes, lambda t: value_of(t, column), "double", fit)

    return StepPlan(learn, {column}, {column})


def target_encode(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Category mean of the target, shrunk towards the global mean."""
    target = params.get("target_col")
    if target not in df.columns:
        raise SkipStep(f"target column '{target}' not found")
    if not is_numeric(type_of(df, target)):
        raise SkipStep(f"target column '{target}' is not numeric")

    def learn(table: DataFrame, fit: Fit) -> Transform:
        prior = fit.stats["prior"]
        if prior is None:
            return lambda t: t.withColumn(column, F.lit(None).cast("double"))
        n, mean = F.col("seen").cast("double"), F.col("mean")
        weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(MIN_SAMPLES_LEAF)) / F.lit(SMOOTHING)))
        groups = table.select(value_of(table, column).alias("v"), number_of(table, target).alias("y")).groupBy("v")
        means = groups.agg(F.count(F.lit(1)).alias("__tn"), F.count("y").alias("seen"), F.avg("y").alias("mean"))
        shrunk = (F.lit(prior) * (F.lit(1.0) - weight) + mean * weight).alias("__te")
        encoded = fit.kept.keep(fit.table("means", lambda: means.select("v", "__tn", shrunk)))
        small = fits_broadcast(encoded)
        fit.shuffled = not small

        def transform(t: DataFrame) -> DataFrame:
            keys = {"v": value_of(t, column)}
            joined = lookup_join(t, encoded, keys, "__tn", fit.kept, null_safe=True, small=small)
            # a category of the fitting table without any target keeps its NULL, one unseen then gets the prior
            mean = F.when(F.col("__tn").isNull(), F.lit(prior)).otherwise(F.col("__te"))
            return joined.withColumn(column, mean).drop("__tn", "__te")

        return transform

    return StepPlan(learn, {column, target}, {column}, {"prior": F.avg(number_of(df, target))})
