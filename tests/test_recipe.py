"""Recipes: order, fusion, refusals, reports, reuse and the batch job."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.plans.catalogue import OPERATIONS
from sparkprep.plans.runner import RecipeError

FULL = sp.Recipe.of(
    ("fill_na_groupby", "c", {"group_col": "g", "strategy": "mode"}),
    ("fill_na_mean", "a"),
    ("fill_na_median", "b"),
    ("drop_outliers_zscore", "b", {"threshold": 2}),
    ("create_interaction", "", {"col1": "a", "math_op": "*", "col2": "b", "new_name": "ab"}),
    ("bin_numeric", "ab", {"bins": 4}),
    ("standard_scaler", "a"),
    ("log_transform", "b"),
    ("drop_duplicates", ""),
    ("robust_scaler", "b"),
    ("polynomial_features", "b", {"degree": 3}),
    ("target_encode", "g", {"target_col": "b"}),
    ("one_hot_encode", "c"),
    ("minmax_scaler", "g"),
    ("drop_column", "id"),
)


def frame(spark, partitions=4):
    n = F.col("id")
    return spark.range(400).select(
        "id",
        F.when(n % 7 > 0, (n * 37 % 101).cast("double")).alias("a"),
        F.when(n % 5 > 0, (n * 53 % 97) - 10.0).alias("b"),
        F.when(n % 11 > 0, F.concat(F.lit("c"), n * 13 % 4)).alias("c"),
        F.concat(F.lit("g"), n % 6).alias("g"),
    ).repartition(partitions)


def rows(df):
    out = [tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in r) for r in df.collect()]
    return sorted(out, key=str)


def test_fusion_changes_passes_not_results(spark):
    fused, single = (sp.fit_recipe(frame(spark), FULL, fuse=f) for f in (True, False))
    assert [r.status for r in fused.results] == ["applied"] * len(FULL.steps)
    assert fused.output.columns == single.output.columns
    assert rows(fused.output) == rows(single.output)
    assert fused.passes < single.passes
    fused.release()
    single.release()


def test_partitioning_does_not_matter(spark):
    one, eight = (sp.apply_recipe(frame(spark, p), FULL) for p in (1, 8))
    assert rows(one) == rows(eight)


def test_ten_independent_steps_share_one_pass(spark):
    names = [f"x{i}" for i in range(10)]
    df = spark.range(100).select(*[(F.col("id") * i).cast("double").alias(n) for i, n in enumerate(names, 1)])
    fitted = sp.fit_recipe(df, sp.Recipe.of(*[("standard_scaler", n) for n in names]))
    assert fitted.passes == 1
    assert fitted.output.agg(*[F.round(F.stddev_pop(n), 9).alias(n) for n in names]).first() == (1.0,) * 10


def test_steps_see_earlier_output(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (3.0, 6.0)], "x double, y double")
    out = sp.apply_recipe(
        df,
        sp.Recipe.of(
            ("fill_na_const", "x", {"value": 100}),
            ("minmax_scaler", "x"),
            ("create_interaction", "", {"col1": "x", "math_op": "+", "col2": "y", "new_name": "z"}),
            ("drop_column", "y"),
            ("fill_na_mean", "y"),
            ("maxabs_scaler", "z"),
        ),
    )
    assert out.columns == ["x", "z"]
    assert max(r["z"] for r in out.collect()) == 1.0


BAD = sp.Recipe.from_dict(
    {
        "steps": [
            {"id": "1", "operation": "sort_rows", "column": "a", "params": {}},
            {"id": "2", "operation": "fill_na_mean", "column": "nope", "params": None},
            {"id": "3", "operation": "standard_scaler", "column": "c", "params": {}},
            {"id": "4", "operation": "bin_numeric", "column": "a", "params": {"labels": "True"}},
            {"id": "5", "operation": "drop_outliers_zscore", "column": "a", "params": {"threshold": "many"}},
            {"id": "6", "operation": "drop_column", "column": "a", "params": {"col": "b"}},
        ]
    }
)


def test_refused_steps_are_reported(spark):
    fitted = sp.fit_recipe(frame(spark), BAD)
    report = {r["step_id"]: r for r in fitted.report(spark).collect()}
    assert [report[str(i)]["status"] for i in range(1, 7)] == [
        "unknown_operation", "skipped", "skipped", "skipped", "failed", "applied",
    ]
    assert report["2"]["reason"] == "column 'nope' not found"
    assert report["6"]["column"] == "b" and fitted.output.columns == ["id", "a", "c", "g"]


def test_one_bad_step_does_not_spoil_its_batch(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 4.0)], "x double, y double")
    fitted = sp.fit_recipe(df, sp.Recipe.of(("standard_scaler", "x"), ("minmax_scaler", "y")))
    assert [r.status for r in fitted.results] == ["skipped", "applied"]
    assert sorted(map(tuple, fitted.output.collect())) == [(1.0, 0.0), (float("inf"), 1.0)]


@pytest.mark.parametrize("step", BAD.steps[:5])
def test_strict_errors(spark, step):
    with pytest.raises(RecipeError, match=step.operation):
        sp.fit_recipe(frame(spark), sp.Recipe([step]), on_error="raise")
    with pytest.raises(ValueError):
        sp.fit_recipe(frame(spark), BAD, mode="sideways")
    with pytest.raises(ValueError):
        sp.fit_recipe(frame(spark), BAD, on_error="ignore")


def test_phased_order(spark):
    recipe = sp.Recipe.of(("label_encode", "g"), ("minmax_scaler", "a"), ("fill_na_const", "a", {"value": 1000}))
    strict, phased = (sp.fit_recipe(frame(spark), recipe, mode=m) for m in ("strict", "phased"))
    assert [r.step.operation for r in phased.results] == ["fill_na_const", "minmax_scaler", "label_encode"]
    assert strict.output.agg(F.max("a")).first()[0] == 1000.0
    assert phased.output.agg(F.max("a")).first()[0] == 1.0


def test_fitted_recipe_on_new_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b")], "x double, k string")
    recipe = sp.Recipe.of(("fill_na_mean", "x"), ("minmax_scaler", "x"), ("one_hot_encode", "k"))
    fitted = sp.fit_recipe(df, recipe)
    new = spark.createDataFrame([(5.0, "c"), (None, "b")], "x double, k string")
    assert sorted(map(tuple, fitted.transform(new).collect())) == [(0.5, True), (2.0, False)]


def test_json(spark):
    assert sp.Recipe.from_json(FULL.to_json()).to_dict() == FULL.to_dict()
    text = json.dumps({"session_id": "s", "steps": [{"id": 1, "operation": "drop_duplicates"}]})
    assert sp.Recipe.from_json(text).steps[0].target == ""


def test_catalogue(spark):
    rows = sp.catalogue(spark).collect()
    assert len(rows) == 24 == len(OPERATIONS)
    assert {r["category"] for r in rows} == {"Cleaning", "Imputation", "Dates", "Math", "Scaling", "Encoding"}
    bins = next(r for r in rows if r["id"] == "bin_numeric")
    assert [(p["name"], p["default"]) for p in bins["params"]] == [
        ("col", None), ("bins", "5"), ("strategy", '"quantile"'), ("labels", '"False"'),
    ]


def test_preview(spark):
    page = sp.preview(frame(spark), sp.Recipe.of(("drop_outliers_manual", "a", {"value": 50})), n=200, show=7, order_by=["id"])
    assert page.columns == ["id", "a", "b", "c", "g"]
    first = frame(spark).orderBy("id").limit(200).where("a < 50").orderBy("id")
    assert page.rows == first.count() and page.data.collect() == first.limit(7).collect()


def test_sanitise(spark):
    df = spark.sql("select double('inf') a, double('nan') b, 1.5d c, timestamp'2024-01-02 03:04:05.5' t, 'x' s")
    assert tuple(sp.sanitise(df).first()) == (None, None, 1.5, "2024-01-02 03:04:05", "x")


@pytest.mark.parametrize("kind", ["", ".parquet"])
def test_batch_job(spark, tmp_path, kind):
    source = tmp_path / "in.csv"
    source.write_text("k,x,day,z\na,1,2024-01-01,NA\nb,,2024-01-02,1\nb,3,oops,2\n")
    recipe = sp.Recipe.of(("fill_na_mean", "x"), ("extract_date_parts", "day", {"drop_original": "True"}))
    done = sp.run_batch(spark, str(source), recipe, f"{tmp_path}/out{kind}")
    summary = done.summary(spark).first()
    assert (summary["steps"], summary["rows"], summary["columns"]) == (2, 3, 8)
    back = sp.read_table(spark, f"{tmp_path}/out{kind}")
    assert back.columns == ["x", "z", "day_year", "day_month", "day_day", "day_dow", "k_a", "k_b"]
    assert sorted(r["x"] for r in back.collect()) == [1.0, 2.0, 3.0]
    assert back.where("k_a").count() == 1 and back.where("day_dow = 0").count() == 1


def test_batch_dummies_equal_pandas(spark, tmp_path):
    pdf = pd.DataFrame({"x": [1.5, 2.5, 0.5], "k": ["b", None, "a"], "f": [True, False, True]})
    pdf.to_csv(tmp_path / "in.csv", index=False)
    sp.run_batch(spark, f"{tmp_path}/in.csv", sp.Recipe([]), f"{tmp_path}/out.parquet")
    back = spark.read.parquet(f"{tmp_path}/out.parquet").toPandas()
    want = pd.get_dummies(pdf)
    assert list(back.columns) == list(want.columns)
    assert sorted(back.values.tolist()) == sorted(want.values.tolist())


@pytest.mark.parametrize("on_error", ["skip", "raise"])
def test_failing_tasks_are_not_skipped(spark, on_error):
    """A broken input is no property of a step: the job's own error comes through."""
    broken = spark.range(10).select(F.expr("if(id < 0, 1.0D, double(raise_error('lost')))").alias("x"))
    with pytest.raises(Exception, match="lost") as caught:
        sp.fit_recipe(broken, sp.Recipe.of(("fill_na_mean", "x")), on_error=on_error)
    assert not isinstance(caught.value, RecipeError)


def test_apply_names_steps_left_out(spark):
    with pytest.warns(UserWarning, match="fill_na_mean"):
        sp.apply_recipe(spark.range(3), sp.Recipe.of(("fill_na_mean", "nothing")))
