"""Fitted recipes written to disk and applied by another session."""

import datetime
import json

import pytest

import sparkprep as sp
from sparkprep.operators import encoding
from sparkprep.plans.catalogue import OPERATIONS

EVERY_STEP = (
    ("fill_na_mode", "k"),
    ("fill_na_mode", "day"),
    ("fill_na_groupby", "a", {"group_col": "k", "strategy": "median"}),
    ("fill_na_groupby", "b", {"group_col": "k", "strategy": "mean"}),
    ("fill_na_const", "g", {"value": "none"}),
    ("fill_na_knn", "c"),
    ("drop_duplicates", ""),
    ("drop_outliers_zscore", "a", {"threshold": 4}),
    ("drop_outliers_manual", "b", {"value": 1e6}),
    ("fill_na_mean", "d"),
    ("fill_na_median", "e"),
    ("extract_date_parts", "when", {"drop_original": "True"}),
    ("bin_numeric", "a", {"bins": 3}),
    ("log_transform", "b"),
    ("box_cox_transform", "d"),
    ("create_interaction", "", {"col1": "c", "col2": "e", "math_op": "*", "new_name": "ce"}),
    ("polynomial_features", "c", {"degree": 2}),
    ("standard_scaler", "c"),
    ("robust_scaler", "e"),
    ("minmax_scaler", "ce"),
    ("maxabs_scaler", "b"),
    ("target_encode", "g", {"target_col": "c"}),
    ("label_encode", "h"),
    ("ordinal_encode", "i"),
    ("one_hot_encode", "k"),
    ("one_hot_encode", "j", {"form": "codes"}),
    ("drop_column", "id"),
)


@pytest.fixture
def table(make):
    n = 60
    gap = lambda i, m, v: None if i % m == 0 else v
    rows = range(n)
    return make(
        "id long, a double, b double, c double, d double, e double, k string, g string, h string, i string, j string, when string, day date",
        id=[i % 55 for i in rows], a=[gap(i, 7, float(i * 7 % 31)) for i in rows], b=[gap(i, 9, i * 1.5 - 20) for i in rows], c=[gap(i, 5, float(i % 13)) for i in rows],
        d=[gap(i, 11, float(i % 17 + 1) ** 2) for i in rows], e=[gap(i, 8, float(i % 10)) for i in rows], k=[gap(i, 6, "pqr"[i % 3]) for i in rows],
        g=[gap(i, 10, f"g{i % 4}") for i in rows], h=[f"h{i % 5}" for i in rows], i=[gap(i, 12, f"i{i % 6}") for i in rows], j=[f"j{i % 9}" for i in rows],
        when=[f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}" for i in rows], day=[gap(i, 4, datetime.date(2024, 1, i % 3 + 1)) for i in rows],
    )


def rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_every_operation_survives(spark, table, tmp_path):
    assert {s[0] for s in EVERY_STEP} == set(OPERATIONS)
    fitted = sp.fit_recipe(table, sp.Recipe.of(*EVERY_STEP), on_error="raise")
    sp.save_fitted(fitted, spark, f"{tmp_path}/r")
    want = rows(fitted.output)
    new = table.where("id % 2 = 0").withColumn("e", table["e"] + 100.0)
    want_new = rows(fitted.transform(new))
    fitted.release()
    other = spark.newSession()
    loaded = sp.load_fitted(other, f"{tmp_path}/r")
    assert loaded.output.columns == fitted.output.columns and loaded.output.count() == 0
    assert [r.status for r in loaded.results] == ["applied"] * len(EVERY_STEP)
    table.write.parquet(f"{tmp_path}/t")
    assert rows(loaded.transform(other.read.parquet(f"{tmp_path}/t"))) == want
    new.write.parquet(f"{tmp_path}/n")
    assert rows(loaded.transform(other.read.parquet(f"{tmp_path}/n"))) == want_new
    assert sorted(r["value"] for r in loaded.tables["j_codes"].collect()) == [f"j{i}" for i in range(1, 9)]
    text = other.read.text(f"{tmp_path}/r/recipe").first()[0]
    assert json.loads(text)["steps"][0]["values"] == {"mode": "q"} or json.loads(text)["steps"][0]["operation"] == "fill_na_mode"


@pytest.mark.parametrize("dense", [1_200, 0])
def test_batch_job_saves_its_dummies(spark, table, tmp_path, monkeypatch, dense):
    monkeypatch.setattr(encoding, "DENSE_COLUMNS", dense)
    source, out, saved = (f"{tmp_path}/{n}.parquet" for n in ("in", "out", "saved"))
    sp.write_table(table.drop("day"), source)
    sp.run_batch(spark, source, sp.Recipe.of(("fill_na_mean", "a"), ("no_such_step", "b")), out, save_to=saved)
    loaded = sp.load_fitted(spark, saved)
    assert rows(loaded.transform(spark.read.parquet(source))) == rows(spark.read.parquet(out))
    assert [r.status for r in loaded.results] == ["applied", "unknown_operation"]


def test_empty_and_refused(spark, table, tmp_path):
    fitted = sp.fit_recipe(table.limit(0), sp.Recipe.of(("fill_na_mean", "a"), ("fill_na_mode", "k"), ("label_encode", "h"), ("extract_date_parts", "when")))
    sp.save_fitted(fitted, spark, f"{tmp_path}/e")
    assert rows(sp.load_fitted(spark, f"{tmp_path}/e").transform(table)) == rows(fitted.transform(table))
    with pytest.raises(Exception, match="(?i)exist"):
        sp.save_fitted(fitted, spark, f"{tmp_path}/e")
