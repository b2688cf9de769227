"""The distributed power search against a plain numpy search."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import ranks
from sparkprep.functions.lookup import Kept
from sparkprep.operators import boxcox


def reference_power(x: np.ndarray) -> float:
    """Golden-section search for the highest normal-plot correlation."""
    x, n = np.sort(x), len(x)
    m = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    m[-1] = 0.5 ** (1 / n)
    m[0] = 1 - m[-1]
    z = np.array([NormalDist().inv_cdf(p) for p in m])
    u = np.log(x) - np.log(x).mean()

    def score(p):
        return np.corrcoef(z, u if p == 0 else np.expm1(p * u) / p)[0, 1]

    grid = np.linspace(-20, 20, 801)
    best = grid[np.argmax([score(p) for p in grid])]
    low, high, ratio = best - 0.1, best + 0.1, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if score(a) > score(b) else (a, high)
    return (low + high) / 2


def power_of(spark, x) -> float | None:
    kept = Kept()
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    found = boxcox.boxcox_power(df, F.col("x"), kept)
    kept.release()
    return found


def test_normal_quantile(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(boxcox.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-14, abs=1e-15)


@pytest.mark.parametrize(
    "name,x",
    [
        ("lognormal", np.random.default_rng(0).lognormal(1, 0.7, 400)),
        ("gamma", np.random.default_rng(1).gamma(2.0, 3.0, 400)),
        ("left", 50 - np.random.default_rng(2).gamma(2.0, 2.0, 400)),
        ("ties", np.random.default_rng(3).integers(1, 6, 400).astype(float)),
        ("hot", np.where(np.random.default_rng(4).random(400) < 0.4, 3.0, np.random.default_rng(5).lognormal(1, 1, 400))),
    ],
)
def test_power(spark, name, x):
    assert power_of(spark, x) == pytest.approx(reference_power(x), abs=2e-5)


def test_power_does_not_depend_on_task_sizes(spark, monkeypatch):
    x = np.random.default_rng(6).integers(1, 30, 300).astype(float)
    whole = power_of(spark, x)
    monkeypatch.setattr(boxcox, "RUN_PIECE", 3)
    monkeypatch.setattr(ranks.running_start, "__defaults__", (50, None))  # many ranges
    assert power_of(spark, x) == pytest.approx(whole, abs=1e-9)


@pytest.mark.parametrize("power", [-3.0, -1.0, -0.01, 0.0, 0.3, 1.0, 4.0])
def test_moments_give_the_correlation(spark, power):
    x = np.unique(np.random.default_rng(7).lognormal(1, 0.6, 300))
    c, z = np.arange(len(x)) % 3 + 1, np.linspace(-2, 2, len(x))
    z -= (c * z).sum() / c.sum()  # normal scores add up to nothing
    scored = spark.createDataFrame([(float(a), int(b), float(b * d), float(b * d * d)) for a, b, d in zip(x, c, z)], "x double, c long, z double, zz double")
    moments = boxcox.Moments(scored, int(c.sum()), math.log(x[0]), math.log(x[-1]))
    u = np.repeat(np.log(x), c)
    own = np.repeat(z, c)
    y = u if power == 0 else np.expm1(power * u) / power
    assert moments.correlation(power) == pytest.approx(np.corrcoef(own, y)[0, 1], abs=1e-9)
    assert abs(moments.peak()) <= boxcox.REACH / moments.half


def test_bessel_ratios():
    series = lambda k, x: sum((x / 2) ** (2 * m + k) / (math.factorial(m) * math.factorial(m + k)) for m in range(60))
    for x in (0.01, 1.0, 8.0):
        got = boxcox.bessel(x, 24)
        assert got == pytest.approx([series(k, x) / series(0, x) for k in range(25)], rel=1e-12)


def test_few_passes_and_the_way_without_moments(spark, monkeypatch):
    x = np.random.default_rng(8).gamma(2.0, 3.0, 300)
    want, asked = reference_power(x), []
    real = boxcox.Moments.peak
    monkeypatch.setattr(boxcox.Moments, "peak", lambda self: asked.append(1) or real(self))
    assert power_of(spark, x) == pytest.approx(want, abs=2e-5) and asked == [1]
    monkeypatch.setattr(boxcox.Moments, "peak", lambda self: 3.0)  # no peak there
    assert power_of(spark, x) == pytest.approx(want, abs=2e-5)
    wide = np.exp(np.random.default_rng(9).normal(0, 8, 300))
    assert power_of(spark, wide) == pytest.approx(reference_power(wide), abs=2e-5)


def test_no_power_for_constants(spark):
    assert power_of(spark, [3.0, 3.0]) is None
    assert power_of(spark, [3.0]) is None


def rows(df):
    return [r["x"] for r in df.orderBy("id").collect()]


def test_transform_fills_shifts_and_bends(make, step):
    x = np.random.default_rng(8).normal(0, 5, 200)
    df = make("id long, x double", 4, id=list(range(201)), x=[*map(float, x), None])
    shift = abs(x.min()) + 1
    power = reference_power(x + shift)
    want = np.expm1(power * np.log1p(np.append(x, np.median(x)) + shift)) / power
    assert rows(step(df, "box_cox_transform", "x")) == pytest.approx(list(want), rel=1e-4)


def test_constant_falls_back_to_the_logarithm(make, step):
    df = make("id long, x double", id=[0, 1, 2], x=[3.0, 3.0, None])
    assert rows(step(df, "box_cox_transform", "x")) == pytest.approx([math.log(4), math.log(4), None])


def test_skew_gate(make, step):
    flat = make("id long, x double", id=[0, 1, 2, 3], x=[1.0, 2.0, 3.0, None])
    assert rows(step(flat, "box_cox_transform", "x", skew_threshold=0.5)) == [1.0, 2.0, 3.0, None]
    x = np.random.default_rng(9).lognormal(0, 1, 100)
    df = make("id long, x double", id=list(range(101)), x=[*map(float, x), None])
    shift = 1.0  # the gap counts as 0 when looking for the minimum
    power = reference_power(np.append(x, x.mean()) + shift)
    got = rows(step(df, "box_cox_transform", "x", skew_threshold=0.5))
    assert got[-1] is None
    assert got[:-1] == pytest.approx(list(np.expm1(power * np.log1p(x + shift)) / power), rel=1e-4)


def test_given_power(make, step):
    df = make("id long, x double", id=[0, 1], x=[1.0, 3.0])
    assert rows(step(df, "box_cox_transform", "x", power=0)) == pytest.approx([math.log(2), math.log(4)])
    assert rows(step(df, "box_cox_transform", "x", power=2)) == pytest.approx([1.5, 7.5])
