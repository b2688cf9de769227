"""Filling missing values from a column's own statistics or its group's."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import INTEGRAL, TIMES, col, is_numeric, number_of, text_of, type_of, value_of
from sparkprep.functions.lookup import Kept, fits_broadcast, lookup_join
from sparkprep.functions.quantiles import group_quantile, quantiles
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform, require_numeric, simple


def _fill(df: DataFrame, column: str, value: Any, missing: int) -> Transform:
    """Missing values of a numeric column become ``value``; the column is double.
    An integer column that had none when fitted stays as it is."""
    if not missing and isinstance(type_of(df, column), INTEGRAL):
        return lambda t: t

    def transform(t: DataFrame) -> DataFrame:
        x = number_of(t, column)
        return t.withColumn(column, x if value is None else F.coalesce(x, F.lit(float(value))))

    return transform


def fill_na_mean(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    require_numeric(df, column)
    return StepPlan(
        lambda table, fit: _fill(df, column, fit.stats["mean"], fit.stats["missing"]),
        {column},
        {column},
        {"mean": F.avg(number_of(df, column)), "missing": F.count_if(number_of(df, column).isNull())},
    )


def fill_na_median(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    require_numeric(df, column)
    return StepPlan(
        lambda table, fit: _fill(df, column, fit.quantiles[0.5], fit.stats["missing"]),
        {column},
        {column},
        {"missing": F.count_if(number_of(df, column).isNull())},
        quantile_column=number_of(df, column),
        quantiles=(0.5,),
    )


def most_frequent(df: DataFrame, value: Column) -> Any:
    """The most frequent non-null value, the smallest on ties.

    Counting by value combines on the map side and the final aggregate carries
    one candidate per partition, so neither a hot value nor millions of distinct
    ones load a single task.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("m")).first()["m"]
    return None if best is None else best["v"]


def fill_na_mode(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    def learn(table: DataFrame, fit: Fit) -> Transform:
        mode = fit.value("mode", lambda: most_frequent(table, value_of(table, column)))
        if mode is None:
            return lambda t: t
        return lambda t: t.withColumn(
            column, F.coalesce(value_of(t, column), F.lit(mode).cast(type_of(t, column)))
        )

    return StepPlan(learn, {column}, {column})


def _parse_constant(value: Any, data_type: T.DataType) -> tuple[Any, T.DataType]:
    """The constant in the column's type, or the text type when it has none."""
    if is_numeric(data_type):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return str(value), T.StringType()
        if isinstance(data_type, INTEGRAL):
            exact = isinstance(value, int) or number.is_integer()
            return (int(value if isinstance(value, int) else number), data_type) if exact else (number, T.DoubleType())
        return number, data_type
    if isinstance(data_type, T.BooleanType) and str(value) in ("True", "False", "true", "false"):
        return str(value).lower() == "true", data_type
    return str(value), T.StringType()


def fill_na_const(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    given = params.get("value", 0)
    if given is None:
        raise SkipStep("no value to fill with")
    if isinstance(type_of(df, column), TIMES):
        parsed = df.sparkSession.range(1).select(F.lit(str(given)).try_cast(type_of(df, column))).first()[0]
        if parsed is None:
            raise SkipStep(f"'{given}' is no value for the {type_of(df, column).simpleString()} column '{column}'")

    def transform(t: DataFrame) -> DataFrame:
        own = type_of(t, column)
        if isinstance(own, TIMES):
            parsed = F.lit(str(given)).try_cast(own)
            return t.withColumn(column, F.coalesce(col(column), parsed))
        value, target = _parse_constant(given, own)
        if isinstance(target, T.StringType):
            kept = text_of(t, column)
        else:
            kept = value_of(t, column).cast(target)
        return t.withColumn(column, F.coalesce(kept, F.lit(value).cast(target)))

    return simple(transform, {column}, {column})


def group_statistic(df: DataFrame, group: str, column: str, strategy: str, kept: Kept) -> DataFrame:
    """One row per non-null group: ``g``, its row count ``n`` and statistic ``q``.

    Every form aggregates on the map side first, so a group with a third of the
    rows costs no more than any other.
    """
    key = value_of(df, group)
    if strategy == "median":
        return group_quantile(df, key, number_of(df, column), 0.5, kept)
    numeric = is_numeric(type_of(df, column))
    x = number_of(df, column) if strategy == "mean" or numeric else col(column)
    rows = df.select(key.alias("g"), x.alias("v")).where("g is not null and v is not null")
    if strategy == "mean":
        return rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("q"))
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("c"), F.col("v").alias("v")))
    return counts.groupBy("g").agg(F.sum("c").alias("n"), best.alias("b")).select("g", "n", F.col("b.v").alias("q"))


def fill_na_groupby(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Missing values take their group's statistic, then the global statistic of
    the partly filled column."""
    group = params.get("group_col")
    strategy = params.get("strategy", "median")
    if group not in df.columns:
        raise SkipStep(f"group column '{group}' not found")
    if strategy not in ("mean", "median", "mode"):
        raise SkipStep(f"unknown strategy '{strategy}'")
    if strategy != "mode":
        require_numeric(df, column)
    as_number = is_numeric(type_of(df, column))

    def learn(table: DataFrame, fit: Fit) -> Transform:
        if isinstance(type_of(df, column), INTEGRAL) and not fit.stats["missing"]:
            return lambda t: t  # nothing to fill: the integers stay exact
        groups = fit.kept.keep(fit.table("groups", lambda: group_statistic(table, group, column, strategy, fit.kept)))
        lookup = groups.select("g", F.col("n").alias("__gn"), F.col("q").alias("__gq"))
        small = fits_broadcast(lookup)
        fit.shuffled = not small

        def current(t: DataFrame) -> Column:
            return number_of(t, column) if as_number else col(column)

        def from_group(t: DataFrame) -> DataFrame:
            joined = lookup_join(t, lookup, {"g": value_of(t, group)}, "__gn", fit.kept, small=small)
            filled = joined.withColumn(column, F.coalesce(current(joined), F.col("__gq")))
            return filled.drop("__gq", "__gn")

        def overall() -> Any:
            filled = from_group(table)
            x = current(filled)
            if filled.where(x.isNull()).isEmpty():
                return None
            if strategy == "mean":
                return filled.agg(F.avg(x)).first()[0]
            if strategy == "median":
                return quantiles(filled, {column: x}, {column: [0.5]})[column][0.5]
            return most_frequent(filled, x)

        rest = fit.value("rest", overall)

        def transform(t: DataFrame) -> DataFrame:
            out = from_group(t)
            if rest is None:
                return out
            return out.withColumn(column, F.coalesce(col(column), F.lit(rest).cast(type_of(out, column))))

        return transform

    return StepPlan(learn, {column, group}, {column}, {"missing": F.count_if(col(column).isNull())})
