"""Box-Cox transform with the power that best straightens the normal plot.

The power maximises the correlation between the transformed, sorted values and
the normal order-statistic medians.  Box-Cox keeps the order of positive values,
so the table is ranked once.  Sums of Chebyshev polynomials of the logarithms then
give the correlation for every power, and a second pass computes it exactly around
the peak.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.columns import col, is_infinite, number_of
from sparkprep.functions.lookup import Kept
from sparkprep.functions.ranks import running_start
from sparkprep.operators.base import Fit, SkipStep, StepPlan, Transform, require_numeric
from sparkprep.operators.numeric import positive_shift

TERMS = 24  # of the series
REACH = 8.0  # power times half the range of the logarithms, up to which the series serves
TIED = 64  # rows per distinct value from which a value's ranks are spread
GRID = 33  # candidate powers per pass where the series does not serve
FINE_STEP = 1e-3  # below this spacing the peak is taken from a parabola
WIDEST = 1e3  # give up widening beyond this range of powers
RUN_PIECE = 1_000_000  # ranks of one tied value handled per task row

# Rational approximation of the normal quantile function
# (M. Wichura, algorithm AS 241, 1988), highest power first.
CENTRE_TOP = (
    2.50908_09287_30122_6727e3, 3.34305_75583_58812_8105e4, 6.72657_70927_00870_0853e4, 4.59219_53931_54987_1457e4,
    1.37316_93765_50946_1125e4, 1.97159_09503_06551_4427e3, 1.33141_66789_17843_7745e2, 3.38713_28727_96366_6080e0,
)
CENTRE_BOTTOM = (
    5.22649_52788_52854_5610e3, 2.87290_85735_72194_2674e4, 3.93078_95800_09271_0610e4, 2.12137_94301_58659_5867e4,
    5.39419_60214_24751_1077e3, 6.87187_00749_20579_0830e2, 4.23133_30701_60091_1252e1, 1.0,
)
MIDDLE_TOP = (
    7.74545_01427_83414_07640e-4, 2.27238_44989_26918_45833e-2, 2.41780_72517_74506_11770e-1,
    1.27045_82524_52368_38258e0, 3.64784_83247_63204_60504e0, 5.76949_72214_60691_40550e0,
    4.63033_78461_56545_29590e0, 1.42343_71107_49683_57734e0,
)
MIDDLE_BOTTOM = (
    1.05075_00716_44416_84324e-9, 5.47593_80849_95344_94600e-4, 1.51986_66563_61645_71966e-2,
    1.48103_97642_74800_74590e-1, 6.89767_33498_51000_04550e-1, 1.67638_48301_83803_84940e0,
    2.05319_16266_37758_82187e0, 1.0,
)
TAIL_TOP = (
    2.01033_43992_92288_13265e-7, 2.71155_55687_43487_57815e-5, 1.24266_09473_88078_43860e-3,
    2.65321_89526_57612_30930e-2, 2.96560_57182_85048_91230e-1, 1.78482_65399_17291_33580e0,
    5.46378_49111_64114_36990e0, 6.65790_46435_01103_77720e0,
)
TAIL_BOTTOM = (
    2.04426_31033_89939_78564e-15, 1.42151_17583_16445_88870e-7, 1.84631_83175_10054_68180e-5,
    7.86869_13114_56132_59100e-4, 1.48753_61290_85061_48525e-2, 1.36929_88092_27358_05310e-1,
    5.99832_20655_58879_37690e-1, 1.0,
)


def _polynomial(coefficients: tuple[float, ...], r: Column) -> Column:
    return reduce(lambda total, c: total * r + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p: Column) -> Column:
    """The standard normal value with probability ``p`` below it."""
    q = p - F.lit(0.5)
    near = F.lit(0.180625) - q * q
    root = F.sqrt(-F.log(F.when(q < 0, p).otherwise(F.lit(1.0) - p)))
    middle, far = root - F.lit(1.6), root - F.lit(5.0)
    tail = F.when(root <= 5.0, _polynomial(MIDDLE_TOP, middle) / _polynomial(MIDDLE_BOTTOM, middle)).otherwise(
        _polynomial(TAIL_TOP, far) / _polynomial(TAIL_BOTTOM, far)
    )
    return F.when(F.abs(q) <= 0.425, q * _polynomial(CENTRE_TOP, near) / _polynomial(CENTRE_BOTTOM, near)).otherwise(
        F.signum(q) * tail
    )


def order_medians(rank: Column, rows: int) -> Column:
    """Medians of uniform order statistics; ``rank`` starts at 0."""
    top = 0.5 ** (1.0 / rows)
    return (
        F.when(rank == 0, F.lit(1.0 - top))
        .when(rank == rows - 1, F.lit(top))
        .otherwise((rank + F.lit(1 - 0.3175)) / F.lit(rows + 0.365))
    )


def normal_scores(values: DataFrame, distinct: int, rows: int) -> DataFrame:
    """Per distinct ``x`` with count ``c``: the sum ``z`` and sum of squares ``zz``
    of the normal scores of its ranks.

    Ranks of one value are handled in pieces; where values have many ranks each,
    the pieces are spread over the cluster, so a value shared by a third of the
    table is many small rows rather than one task.
    """
    ranked = running_start(values, "x", F.col("c"), rows=distinct)
    end = F.col("start") + F.col("c") - 1
    pieces = ranked.select(
        "x", "c", end.alias("last"), F.explode(F.sequence("start", end, F.lit(RUN_PIECE).cast("long"))).alias("first")
    )
    if rows > TIED * distinct:
        pieces = pieces.repartition("x", "first")
    stop = F.least(F.col("last"), F.col("first") + RUN_PIECE - 1)
    ranks = pieces.select("x", "c", F.explode(F.sequence("first", stop)).alias("rank"))
    z = normal_quantile(order_medians(F.col("rank"), rows))
    scored = ranks.select("x", "c", z.alias("z"))
    return scored.groupBy("x").agg(
        F.max("c").alias("c"), F.sum("z").alias("z"), F.sum(F.col("z") * F.col("z")).alias("zz")
    )


class Moments:
    """Sums over the values of Chebyshev polynomials of their logarithm ``u = middle + half * t``.

    ``exp(p * u) = exp(p * middle) * (I0(p * half) + 2 * sum of Ik(p * half) * Tk(t))`` with
    Bessel functions ``Ik`` gives the correlation for every power from one pass.
    The series is used up to ``|p * half| = REACH``.
    """

    def __init__(self, scored: DataFrame, rows: int, low: float, high: float):
        self.rows, self.middle, self.half = rows, (low + high) / 2, (high - low) / 2
        t = (F.log("x") - F.lit(self.middle)) / F.lit(self.half)
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t)))
        terms = [F.cos(F.lit(float(k)) * angle) for k in range(1, 2 * TERMS + 1)]
        own = [F.sum(F.col("c") * x).alias(f"c{k}") for k, x in enumerate(terms, 1)]
        crossed = [F.sum(F.col("z") * x).alias(f"z{k}") for k, x in enumerate(terms[:TERMS], 1)]
        sums = scored.agg(F.sum("zz").alias("zz"), *own, *crossed).first()
        self.zz, self.z = sums["zz"], [sums[f"z{k}"] for k in range(1, TERMS + 1)]
        m = [float(rows)] + [sums[f"c{k}"] for k in range(1, 2 * TERMS + 1)]
        self.spread = [[(m[j + k] + m[abs(j - k)]) / 2 - m[j] * m[k] / rows for k in range(1, TERMS + 1)] for j in range(1, TERMS + 1)]

    def correlation(self, power: float) -> float:
        """Of the normal scores with ``exp(power * u) / power``; for power 0 with ``u``."""
        weights = bessel(abs(power) * self.half, TERMS)[1:] if power else [1.0] + [0.0] * (TERMS - 1)
        if power < 0:  # Tk(-t) has the sign of (-1)^k; dividing by the power turns all signs once more
            weights = [w if k % 2 else -w for k, w in enumerate(weights, 1)]
        along = sum(w * z for w, z in zip(weights, self.z))
        spread = sum(a * b * s for a, row in zip(weights, self.spread) for b, s in zip(weights, row))
        return along / math.sqrt(self.zz * spread) if spread > 0 else -math.inf

    def peak(self) -> float:
        """The power with the highest correlation, as far as the series reaches."""
        edge = REACH / self.half
        low, high = -edge, edge
        for _ in range(8):
            step = (high - low) / 64
            powers = [low + i * step for i in range(65)]
            best = max(powers, key=lambda p: (self.correlation(p), -abs(p)))
            low, high = max(best - step, -edge), min(best + step, edge)
        return best


def bessel(x: float, count: int) -> list[float]:
    """``Ik(x)`` for k from 0 to ``count``, all divided by the same number, by the backward recurrence of the ratios."""
    if x == 0:
        return [1.0] + [0.0] * count
    above, ratios = 0.0, []
    for k in range(count + 40 + int(x), 0, -1):
        above = 1.0 / (2.0 * k / x + above)  # Ik / I(k-1)
        ratios.append(above)
    values = [1.0]
    for r in reversed(ratios[-count:]):
        values.append(values[-1] * r)
    return values


def best_power(scored: DataFrame, rows: int, low: float, high: float) -> float | None:
    """The power with the highest correlation; None when there is none.

    ``low`` and ``high`` are the least and greatest logarithm.  The moments place
    the peak, a second pass over the values computes the correlation exactly at a
    few powers around it.  If the peak is not among them (values over so many
    magnitudes that the series does not reach it), a grid of exact powers in each
    pass finds it.
    """
    centre = (low + high) / 2
    u = F.log("x") - F.lit(centre)

    def correlations(powers: list[float]) -> dict[float, float]:
        aggs = [F.sum("zz").alias("zz")]
        for i, p in enumerate(powers):
            y = F.expm1(F.lit(p) * u) / F.lit(p) if p else u
            aggs += [F.sum(F.col("c") * y).alias(f"a{i}"), F.sum(F.col("c") * y * y).alias(f"b{i}"), F.sum(F.col("z") * y).alias(f"d{i}")]
        sums = scored.agg(*aggs).first()
        out = {}
        for i, p in enumerate(powers):
            spread = sums[f"b{i}"] - sums[f"a{i}"] * sums[f"a{i}"] / rows
            if spread > 0 and math.isfinite(spread):
                out[p] = sums[f"d{i}"] / math.sqrt(sums["zz"] * spread)
        return out

    def top(scores: dict[float, float], step: float) -> tuple[float, bool]:
        """The best power, between its neighbours by a parabola; whether it has two."""
        ordered = sorted(scores)
        best = max(scores, key=lambda p: (scores[p], -abs(p)))
        place = ordered.index(best)
        if place in (0, len(ordered) - 1):
            return best, False
        left, right = scores[ordered[place - 1]], scores[ordered[place + 1]]
        bend = left - 2 * scores[best] + right
        return best + (step / 2 * (left - right) / bend if bend else 0.0), True

    near = lambda p: 0.0 if abs(p) < 1e-12 else p
    guess = Moments(scored, rows, low, high).peak()
    step = FINE_STEP / 2
    scores = correlations([near(guess + i * step) for i in (-2, -1, 0, 1, 2)])
    if len(scores) == 5:
        best, inside = top(scores, step)
        if inside:
            return best
    low, high = -2.0, 2.0
    while True:
        step = (high - low) / (GRID - 1)
        scores = correlations([near(low + i * step) for i in range(GRID)])
        if not scores:
            return None
        best, inside = top(scores, step)
        if not inside:
            if high - low > WIDEST:
                return best
            low, high = best - (high - low), best + (high - low)  # the search is not bounded
        elif step > FINE_STEP:
            low, high = best - step, best + step
        else:
            return best


def boxcox_power(df: DataFrame, values: Column, kept: Kept) -> float | None:
    """The best power for the positive, non-null ``values``."""
    counts = kept.keep(
        df.select(values.alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    )
    ends = [F.log(F.min("x")).alias("low"), F.log(F.max("x")).alias("high")]
    size = counts.agg(F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("rows"), *ends).first()
    if size["distinct"] < 2 or not size["low"] < size["high"]:
        return None
    scored = kept.keep(normal_scores(counts, size["distinct"], size["rows"]))
    return best_power(scored, size["rows"], size["low"], size["high"])


def boxcox1p(x: Column, power: float) -> Column:
    """``((1 + x) ** power - 1) / power``, or ``log1p(x)`` for power 0."""
    if power == 0:
        return F.log1p(x)
    return F.expm1(F.lit(power) * F.log1p(x)) / F.lit(power)


def box_cox_transform(df: DataFrame, column: str, params: dict[str, Any]) -> StepPlan:
    """Fills gaps with the median, shifts to positive and applies the best power.

    ``skew_threshold`` switches to the batch rule: only a column whose absolute
    population skewness exceeds it is transformed, and its gaps stay.
    ``power`` skips the search and applies the given power; ``digits`` rounds the
    power found to so many decimals.
    """
    require_numeric(df, column)
    gate = params.get("skew_threshold")
    given = params.get("power")
    x = number_of(df, column)

    def learn(table: DataFrame, fit: Fit) -> Transform:
        s = fit.stats
        if s["infinite"]:
            raise SkipStep(f"column '{column}' holds infinite values")
        if gate is not None:
            if s["skew"] is None or not abs(s["skew"]) > float(gate):
                return lambda t: t
            low = s["min"] if not s["missing"] else min(s["min"], 0.0)
            filler, stand_in = None, s["mean"]
        else:
            low, stand_in = s["min"], None
            filler = fit.quantiles[0.5]
        shift = positive_shift(low)
        power = float(given) if given is not None else None
        if power is None and s["min"] is not None:
            sample = number_of(table, column)
            if stand_in is not None:
                sample = F.coalesce(sample, F.lit(stand_in))
            power = fit.value("power", lambda: boxcox_power(table, sample + F.lit(shift), fit.kept))
            if power is not None and params.get("digits") is not None:
                power = round(power, int(params["digits"]))
        if power is None:  # constant or empty column
            return lambda t: t.withColumn(column, F.log1p(number_of(t, column)))

        def transform(t: DataFrame) -> DataFrame:
            value = number_of(t, column)
            if filler is not None:
                value = F.coalesce(value, F.lit(filler))
            return t.withColumn(column, boxcox1p(value + F.lit(shift), power))

        return transform

    stats = {
        "min": F.min(x),
        "mean": F.avg(x),
        "missing": F.count_if(x.isNull()),
        "infinite": F.count_if(is_infinite(x)),
        "skew": F.skewness(x),
    }
    if gate is not None:
        return StepPlan(learn, {column}, {column}, stats)
    return StepPlan(learn, {column}, {column}, stats, x, (0.5,))
