"""Binning, logarithm, interactions and powers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.columns import INTEGRAL, TIMES, col, is_infinite, is_numeric, number_of, tells_case, type_of, value_of
from sparkprep.functions.ranks import passed
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform, as_flag, require_numeric, simple


def evenly_spaced(low: float, high: float, bins: int) -> list[float]:
    """The ``bins + 1`` edges of equal-width bins over ``[low, high]``."""
    width = (high - low) / bins
    return [i * width + low for i in range(bins)] + [high]


def even_bin(x: Column, low: Column, width: Column, bins: int, closed: str) -> Column:
    """The 0-based equal-width bin of ``x``: its place by division, then moved by
    one where the edges as written say otherwise."""
    guess = F.least(F.greatest(F.floor((x - low) / width), F.lit(0)), F.lit(bins - 1))

    def edge(i: Column) -> Column:
        return i * width + low

    if closed == "left":
        down, up = x < edge(guess), x >= edge(guess + 1)
    else:
        down, up = x <= edge(guess), x > edge(guess + 1)
    return F.when(down & (guess > 0), guess - 1).when(up & (guess < bins - 1), guess + 1).otherwise(guess)


def count_edges(edges: list[float], x: Column, test) -> Column:
    """How many ascending ``edges`` the value has passed: its 0-based bin, found in log steps."""
    return passed(edges, x, test)


def bin_numeric(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Codes of right-closed bins with equal counts or equal widths."""
    require_numeric(df, column)
    bins = int(params.get("bins", 5))
    labels = params.get("labels", False)
    listed = labels is None or isinstance(labels, (list, tuple))
    if not listed and str(labels) != "False":
        raise SkipStep("labels must be False or a list with one name per bin")
    if bins < 1:
        raise SkipStep("bins must be at least 1")
    by_quantile = params.get("strategy", "quantile") == "quantile"
    x = number_of(df, column)

    def coder(fit: Fit) -> tuple[Callable[[Column], Column] | None, int]:
        """How a value becomes its code (None when the column cannot be cut), and
        the number of bins."""
        if by_quantile:
            edges = sorted({v for v in fit.quantiles.values() if v is not None})
            inner = edges[1:-1]
            return (lambda x: count_edges(inner, x, lambda x, e: x > e)) if len(edges) > 1 else None, len(inner) + 1
        low, high = fit.stats["min"], fit.stats["max"]
        if low is None:
            raise SkipStep(f"column '{column}' has no values to cut")
        if fit.stats["infinite"]:
            raise SkipStep(f"column '{column}' holds infinite values")
        if low == high:
            margin = 0.001 * abs(low) if low else 0.001
            low, high = low - margin, high + margin
        width = (high - low) / bins
        return (lambda x: even_bin(x, F.lit(low), F.lit(width), bins, "right")), bins

    def learn(table: DataFrame, fit: Fit) -> Transform:
        code_of, count = coder(fit)
        if isinstance(labels, (list, tuple)) and code_of is not None and len(labels) != count:
            raise SkipStep(f"{len(labels)} labels for {count} bins")

        def transform(t: DataFrame) -> DataFrame:
            value = number_of(t, column)
            code = F.lit(None) if code_of is None else F.when(value.isNotNull(), code_of(value))
            code = code.cast("long")
            return t.withColumn(column, F.coalesce(code, F.lit(-1).cast("long")) if listed else code)

        return transform

    if by_quantile:
        wanted = tuple(i * (1.0 / bins) for i in range(bins)) + (1.0,)
        return StepPlan(learn, {column}, {column}, quantile_column=x, quantiles=wanted)
    stats = {"min": F.min(x), "max": F.max(x), "infinite": F.count_if(is_infinite(x))}
    return StepPlan(learn, {column}, {column}, stats)


def positive_shift(low: float | None) -> float:
    """What to add so that the smallest value becomes positive."""
    return abs(low) + 1 if low is not None and low <= 0 else 0.0


def log_transform(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """``log1p`` of the column, shifted when it holds zero or negative values;
    ``shift=False`` takes the plain logarithm."""
    require_numeric(df, column)

    def transform_with(offset: float) -> Transform:
        return lambda t: t.withColumn(column, F.log1p(number_of(t, column) + F.lit(offset)))

    if str(params.get("shift", True)).lower() == "false":
        return simple(transform_with(0.0), {column}, {column})
    return StepPlan(
        lambda table, fit: transform_with(positive_shift(fit.stats["min"])),
        {column},
        {column},
        {"min": F.min(number_of(df, column))},
    )


def create_interaction(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """A new column from two others; a zero divisor or an overflow gives NULL."""
    left, right = params.get("col1"), params.get("col2")
    name, sign = params.get("new_name"), params.get("math_op", "+")
    if left not in df.columns or right not in df.columns:
        raise SkipStep("both input columns must exist")
    if sign not in ("+", "-", "*", "/"):
        raise SkipStep(f"unknown operator '{sign}'")
    if not name:
        raise SkipStep("new_name is missing")
    alike = [c for c in df.columns if c != name and c.lower() == name.lower()]
    if alike and not tells_case(df.sparkSession):
        raise SkipStep(f"'{name}' would replace the column '{alike[0]}'")

    def combine(t: DataFrame) -> Column:
        types = [type_of(t, left), type_of(t, right)]
        truths = [isinstance(x, T.BooleanType) for x in types]
        if all(truths) and sign in "+*":  # of two truth values: or, and
            return col(left) | col(right) if sign == "+" else col(left) & col(right)
        if all(is_numeric(x) or truth for x, truth in zip(types, truths)) and not (all(truths) and sign == "-"):
            a, b = (col(c).cast("long") if truth else value_of(t, c) for c, truth in zip((left, right), truths))
            types = [T.LongType() if truth else x for x, truth in zip(types, truths)]
            if sign == "/":
                return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
            if all(isinstance(x, INTEGRAL) for x in types):
                a, b = a.cast("long"), b.cast("long")
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign](a, b)
        if all(isinstance(x, T.StringType) for x in types) and sign == "+":
            return F.concat(col(left), col(right))
        if all(isinstance(x, TIMES) for x in types) and sign == "-":
            micros = [F.unix_micros(col(c).cast("timestamp")) for c in (left, right)]
            return (micros[0] - micros[1]) / F.lit(1e6)  # seconds
        raise SkipStep(f"cannot apply '{sign}' to {types[0].simpleString()} and {types[1].simpleString()}")

    combine(df)  # type errors surface while planning, not at run time
    return simple(lambda t: t.withColumn(name, combine(t)), {left, right}, {name})


def polynomial_features(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Adds powers 2 to ``degree``.  Any missing or infinite value skips the
    step, unless ``null_policy='propagate'``; ``include_degree_1`` also adds the
    first power."""
    require_numeric(df, column)
    degree = int(params.get("degree", 2))
    propagate = params.get("null_policy") == "propagate"
    powers = range(1 if as_flag(params.get("include_degree_1")) else 2, degree + 1)
    names = {i: f"{column}_poly_{i}" for i in powers}
    x = number_of(df, column)

    def learn(table: DataFrame, fit: Fit) -> Transform:
        if not propagate and fit.stats["bad"]:
            raise SkipStep(f"column '{column}' holds missing or infinite values")
        return lambda t: t.withColumns({n: F.pow(number_of(t, column), F.lit(float(i))) for i, n in names.items()})

    stats = {"bad": F.count_if(x.isNull() | is_infinite(x))}
    return StepPlan(learn, {column}, set(names.values()), stats)
