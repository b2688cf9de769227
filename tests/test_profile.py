"""The profile against pandas and numpy, and on edge frames."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.functions import quantiles as q
from sparkprep.plans.profile import HEAD, distinct_words, value_counts


def rows(df):
    return {r["name"]: r.asDict(recursive=True) for r in sp.profile(df).columns.collect()}


def test_against_pandas(spark, monkeypatch):
    monkeypatch.setattr(q, "SAMPLE_ROWS", 50)
    rng = np.random.default_rng(0)
    n = 700
    pdf = pd.DataFrame(
        {
            "x": np.where(rng.random(n) < 0.1, np.nan, rng.normal(3, 2, n)),
            "i": rng.integers(0, 9, n),
            "k": [None if v < 0.3 else f"v{int(v * 40)}" for v in rng.random(n)],
            "flag": rng.random(n) < 0.4,
        }
    )
    pdf = pd.concat([pdf, pdf.iloc[:25]], ignore_index=True)
    df = spark.createDataFrame(pdf).repartition(6)
    found = rows(df)
    totals = sp.profile(df).table.first()
    assert totals["total_rows"] == 725 and totals["duplicate_rows"] == pdf.duplicated().sum()
    assert totals["missing_cells"] == pdf.isna().sum().sum() and totals["total_cols"] == 4 and not totals["clean"]
    for name in ("x", "i"):
        s, r = pdf[name].dropna(), found[name]
        assert r["type"] == "numeric" and r["top_value"] is None
        stats = [r["mean"], r["median"], r["std_dev"], r["min"], r["max"]]
        assert stats == pytest.approx([s.mean(), s.median(), s.std(), s.min(), s.max()], abs=0.0051)
        counts, edges = np.histogram(s, bins=10)
        assert [b["value"] for b in r["distribution"]] == list(counts)
        assert [b["label"] for b in r["distribution"]] == [f"{a:.1f}-{b:.1f}" for a, b in zip(edges, edges[1:])]
    for name in ("k", "flag"):
        s, r = pdf[name].dropna().astype(str), found[name]
        counts = sorted(s.value_counts().items(), key=lambda c: (-c[1], c[0]))
        assert r["type"] == "categorical" and r["mean"] is None
        assert (r["top_value"], r["freq"]) == counts[0]
        assert [(b["label"], b["value"]) for b in r["distribution"]] == counts[:20]
    for name, r in found.items():
        assert r["unique"] == pdf[name].nunique() and r["missing"] == pdf[name].isna().sum()
        assert r["missing_pct"] == round(pdf[name].isna().mean() * 100, 1)
    assert found["k"]["truncated"] and found["k"]["warn_missing"] and not found["k"]["high_missing"]


def test_approximate_unique_keeps_top_values(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", 2.0), (3, "a", None)], "i long, k string, x double")
    exact, rough = rows(df), {r["name"]: r.asDict(recursive=True) for r in sp.profile(df, True).columns.collect()}
    assert exact == rough


def test_empty_one_row_all_missing_and_constant(make, spark):
    empty = make("x double, k string", x=[], k=[])
    assert sp.profile(empty).table.first()["total_rows"] == 0
    r = rows(empty)
    assert r["x"]["missing_pct"] is None and r["x"]["distribution"] == [] and r["k"]["unique"] == 0
    one = rows(make("x double", x=[5.0]))["x"]
    assert (one["mean"], one["std_dev"], one["unique"]) == (5.0, None, 1)
    gone = rows(make("x double, k string", x=[None, float("nan")], k=[None, None]))
    assert gone["x"]["missing"] == 2 and gone["x"]["mean"] is None and gone["x"]["high_missing"]
    assert gone["k"]["top_value"] is None and gone["k"]["distribution"] == []
    constant = rows(make("x double", x=[3.0] * 4))["x"]["distribution"]
    assert constant[0]["label"] == "2.5-2.6" and constant[-1]["label"] == "3.4-3.5"
    assert [b["value"] for b in constant] == [0, 0, 0, 0, 0, 4, 0, 0, 0, 0]


def test_infinite_values_have_no_histogram(make):
    r = rows(make("x double", x=[1.0, float("inf"), None]))["x"]
    assert r["distribution"] == [] and r["missing"] == 1 and r["max"] == float("inf")


def test_top_ties_and_times(make, spark):
    r = rows(make("k string", 3, k=["b", "a", "c", "a", "b", None, None, None]))["k"]
    assert (r["top_value"], r["freq"], r["unique"]) == ("a", 2, 3)
    t = spark.sql("select explode(array(timestamp'2024-01-02', timestamp'2024-01-01', null)) as t")
    r = rows(t)["t"]
    assert (r["type"], r["top_value"], r["unique"]) == ("categorical", "2024-01-01 00:00:00", 2)


def test_large_longs_stay_apart(make):
    assert rows(make("x long", x=[2**62, 2**62 + 1]))["x"]["unique"] == 2


def test_select(make):
    df = make("`Size A` double, name string, other double", **{"Size A": [1.0], "name": [None], "other": [2.0]})
    p = sp.profile(df)

    def names(*args):
        return [r["name"] for r in p.select(*args).orderBy("position").collect()]

    assert names() == ["Size A", "name", "other"]
    assert names("Numeric") == ["Size A", "other"]
    assert names("Categorical") == ["name"] == names("Missing")
    assert names("All", "SIZE") == ["Size A"]
    assert names("Missing", "size") == []


def test_logical_bytes(make):
    df = make("x double, k string, f boolean", x=[1.0, None], k=["ab", "ü"], f=[True, None])
    assert sp.profile(df).table.first()["logical_bytes"] == 2 * 8 + 4 + 2


@pytest.mark.parametrize("name", ["region", "customer", "events", "embeddings", "pages", "conversations"])
def test_given_tables(spark, name):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    found = sp.profile(df)
    assert [r["name"] for r in found.columns.collect()] == df.columns
    totals = found.table.first()
    assert (totals["total_rows"], totals["duplicate_rows"], totals["missing_cells"]) == (df.count(), 0, 0)


def test_long_texts_are_counted_by_hash(spark, make):
    start = "x" * HEAD
    texts = [start + str(i // 2) for i in range(60)] + [start] * 2 + ["a", "a", "a", None]
    df = make("t string", partitions=3, t=texts)
    row = sp.profile(df).columns.first()
    counts = sorted(Counter(t for t in texts if t).items(), key=lambda c: (-c[1], c[0]))
    assert row["unique"] == len(counts)
    assert [tuple(b) for b in row["distribution"]] == counts[:20]
    exchange = value_counts(df)["text"]._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in exchange.splitlines() if "hashpartitioning" in line]
    assert shuffles and all("h1" in line for line in shuffles)


def test_distinct_numbers_by_words(spark, make):
    reals = [0.0, -0.0, 0.01, -0.01, 0.29, 0.1 + 0.2, 0.3, 1e300, -1e300, 2.0**45, 2.0**45 + 0.25, 1 / 3, float("nan"), None, float("inf"), 655.36, -0.64, 655.36]
    wholes = [0, -1, 63, 64, -64, -65, 2**63 - 1, -(2**63), 2**62, None, 64, 63, -1, 5, 6, 7, 8, 9]
    found = rows(make("x double, i long", 5, x=reals, i=wholes))
    assert found["x"]["unique"] == len({v for v in reals if v is not None and v == v})
    assert found["i"]["unique"] == len(set(wholes) - {None})


def test_neighbouring_numbers_share_words(spark):
    df = spark.range(64_000).selectExpr("id", "id / 100 as cents", "id / 7 as odd")
    words = distinct_words(df, "whole", [(0, F.col("id"))])
    assert words.count() == 1000
    assert distinct_words(df, "real", [(1, F.col("cents"))]).count() == 1000
    assert [r["unique"] for r in sp.profile(df).columns.collect()] == [64_000] * 3
