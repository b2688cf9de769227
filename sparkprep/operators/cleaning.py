"""Dropping columns, duplicate rows and outliers."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import INTEGRAL, col, number_of, type_of
from sparkprep.functions.duplicates import first_of_equal, without_duplicates
from sparkprep.operators.base import Fit, StepPlan, Transform, require_numeric, simple


def drop_column(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    return simple(lambda t: t.drop(col(column)), set(), {column})


def drop_duplicates(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Full-row distinct; NULL equals NULL and NaN.

    ``position`` names a column (such as a row number) that plays no part in the
    comparison: of equal rows the one with the smallest position stays.  A table
    without that column is compared in full.
    """
    position = params.get("position")

    def learn(table: DataFrame, fit: Fit) -> Transform:
        def transform(t: DataFrame) -> DataFrame:
            if position in t.columns and len(t.columns) > 1:
                return first_of_equal(t, position, fit.kept)
            return without_duplicates(t, fit.kept)

        return transform

    return StepPlan(learn, set(), set(), removes_rows=True, whole_row=True, shuffles_table=True)


def below(df: DataFrame, column: str, limit: float, inclusive: bool = False) -> Column:
    """``x < limit`` (or ``<=``) in a form that reaches the parquet scan: an integer
    column is compared with an integer, not cast to double row by row."""
    if isinstance(type_of(df, column), INTEGRAL) and math.isfinite(limit) and abs(limit) < 1 << 63:
        return col(column) <= F.lit(math.floor(limit)) if inclusive else col(column) < F.lit(math.ceil(limit))
    return col(column) <= F.lit(limit) if inclusive else col(column) < F.lit(limit)


def drop_outliers_manual(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Keep ``x < value``.  The plain comparison reaches the parquet scan; NULL
    and NaN (which sorts above every number) both fail it."""
    require_numeric(df, column)
    limit = float(params.get("value", 0))
    return simple(lambda t: t.where(below(t, column, limit)), {column}, set(), removes_rows=True)


def drop_outliers_zscore(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Keep rows with ``|x - mean| / sample std < threshold``; NULL rows go."""
    require_numeric(df, column)
    threshold = float(params.get("threshold", 3))
    x = number_of(df, column)

    def learn(table: DataFrame, fit: Fit) -> Transform:
        mean, std = fit.stats["mean"], fit.stats["std"]
        if std == 0:
            return lambda t: t
        if mean is None or std is None or std != std:
            return lambda t: t.where(F.lit(False))
        # The range is the same test a little widened: parquet can skip row
        # groups by it, the exact comparison below decides.
        reach = threshold * std * (1 + 1e-9) + 1e-9 * abs(mean)

        def transform(t: DataFrame) -> DataFrame:
            score = F.abs((number_of(t, column) - F.lit(mean)) / F.lit(std))
            near = ~below(t, column, mean - reach) & below(t, column, mean + reach, inclusive=True)
            return t.where(near & (score < F.lit(threshold)))

        return transform

    stats = {"mean": F.avg(x), "std": F.stddev_samp(x)}
    return StepPlan(learn, {column}, set(), stats, removes_rows=True)
