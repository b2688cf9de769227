"""Linear scalers: one fused aggregate each, then a projection."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import col, is_infinite, number_of
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform, require_numeric


def _scaler(df: DataFrame, column: str, stats: dict, centre_and_spread, quantiles: tuple[float, ...] = ()) -> StepPlan:
    require_numeric(df, column)
    x = number_of(df, column)

    def learn(table: DataFrame, fit: Fit) -> Transform:
        if fit.stats["infinite"]:
            raise SkipStep(f"column '{column}' holds infinite values")
        centre, spread = centre_and_spread(fit)

        def transform(t: DataFrame) -> DataFrame:
            value = number_of(t, column)
            if centre is None:
                return t.withColumn(column, value)
            return t.withColumn(column, (value - F.lit(float(centre))) / F.lit(float(spread or 1.0)))

        return transform

    aggs = {"infinite": F.count_if(is_infinite(x))} | {k: f(x) for k, f in stats.items()}
    return StepPlan(learn, {column}, {column}, aggs, x if quantiles else None, quantiles)


def standard_scaler(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """``(x - mean) / population std``."""
    return _scaler(
        df, column, {"mean": F.avg, "std": F.stddev_pop}, lambda fit: (fit.stats["mean"], fit.stats["std"])
    )


def minmax_scaler(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """``(x - min) / (max - min)``."""

    def fitted(fit: Fit):
        low, high = fit.stats["min"], fit.stats["max"]
        return (None, None) if low is None else (low, high - low)

    return _scaler(df, column, {"min": F.min, "max": F.max}, fitted)


def robust_scaler(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """``(x - median) / (q75 - q25)`` with interpolated quantiles."""

    def fitted(fit: Fit):
        q25, q50, q75 = (fit.quantiles[p] for p in (0.25, 0.5, 0.75))
        return (None, None) if q50 is None else (q50, q75 - q25)

    return _scaler(df, column, {}, fitted, (0.25, 0.5, 0.75))


def maxabs_scaler(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """``x / max |x|``."""
    return _scaler(
        df,
        column,
        {"top": lambda x: F.max(F.abs(x))},
        lambda fit: (None, None) if fit.stats["top"] is None else (0.0, fit.stats["top"]),
    )
