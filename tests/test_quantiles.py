import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.functions import quantiles as q
from sparkprep.functions.lookup import Kept

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns_of(rng, n):
    return {
        "normal": rng.normal(size=n),
        "ties": rng.integers(0, 4, size=n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(7, 2, size=n)),
        "two": np.where(rng.random(n) < 0.5, 1.0, 2.0),
        "wide": rng.lognormal(0, 6, size=n),
        "constant": np.full(n, 3.0),
    }


@pytest.mark.parametrize("accuracy,fetch,sample", [(10_000, 200_000, 100_000), (16, 40, 100_000), (16, 40, 300)])
def test_exact_on_every_path(spark, monkeypatch, accuracy, fetch, sample):
    """Coarse sketches, tiny samples and tiny read-outs still give numpy's answer."""
    monkeypatch.setattr(q, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(q, "DIRECT_ROWS", 0)
    rng = np.random.default_rng(5)
    data = columns_of(rng, 3_000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], list(data)).repartition(7)
    found = q.quantiles(
        df, {c: F.col(c) for c in data}, {c: SHARES for c in data}, accuracy=accuracy, fetch_rows=fetch
    )
    for name, values in data.items():
        for p in SHARES:
            assert found[name][p] == pytest.approx(np.quantile(values, p), rel=1e-12), (name, p)


def test_sparse_and_empty_columns(spark, monkeypatch):
    monkeypatch.setattr(q, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(q, "DIRECT_ROWS", 0)
    df = spark.range(5_000).select(
        F.when(F.col("id") == 4_321, F.lit(9.0)).alias("one"),
        F.when(F.col("id") < 3, F.col("id").cast("double")).alias("few"),
        F.lit(None).cast("double").alias("none"),
        F.col("id").cast("double").alias("all"),
    )
    found = q.quantiles(df, {c: F.col(c) for c in df.columns}, {c: [0.5] for c in df.columns})
    assert found == {"one": {0.5: 9.0}, "few": {0.5: 1.0}, "none": {0.5: None}, "all": {0.5: 2499.5}}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7])
def test_small_counts(spark, size):
    values = np.arange(size, dtype=float) ** 2
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    found = q.quantiles(df, {"x": F.col("x")}, {"x": SHARES})["x"]
    assert [found[p] for p in SHARES] == pytest.approx([np.quantile(values, p) for p in SHARES])


@pytest.mark.parametrize(
    "accuracy,small_group,bracket_rows", [(10_000, 20_000, 10**6), (20, 0, 10**6), (3, 0, 10**6), (20, 0, 200), (500, 0, 1)]
)
def test_group_quantile(spark, monkeypatch, accuracy, small_group, bracket_rows):
    monkeypatch.setattr(q, "GRID", 40)
    rng = np.random.default_rng(2)
    groups = rng.choice(["hot", "b", "c", "d"], p=[0.7, 0.1, 0.1, 0.1], size=4_000)
    values = np.where(rng.random(4_000) < 0.2, 1.5, rng.normal(size=4_000))
    rows = [(str(g), float(v)) for g, v in zip(groups, values)] + [(None, 1.0), ("e", None), ("f", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    kept = Kept()
    out = q.group_quantile(df, F.col("k"), F.col("x"), 0.5, kept, accuracy, small_group, bracket_rows).collect()
    kept.release()
    expected = {g: np.median(values[groups == g]) for g in np.unique(groups)} | {"f": 2.0}
    assert {r["g"]: r["q"] for r in out} == pytest.approx(expected)
    assert sum(r["n"] for r in out) == 4_001


def test_many_ranks_by_running_totals(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(5)
    wanted = [i / 300 for i in range(301)]
    found = q.quantiles(df, {"x": F.col("x")}, {"x": wanted})["x"]
    assert [found[p] for p in wanted] == pytest.approx(np.quantile(values, wanted).tolist(), rel=1e-12)
