"""Each operation against pandas or its formula, and on edge frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep import Recipe, fit_recipe, read_table, run_batch, write_table
from sparkprep.functions.columns import double_text
from sparkprep.operators import dates, encoding
from sparkprep.plans.batch import codes_path, transform_table

NAN, INF = float("nan"), float("inf")


def values(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def frame(make, xs, kind="double", **more):
    schema = f"id long, x {kind}" + "".join(f", {n} {k}" for n, (k, _) in more.items())
    return make(schema, 3, id=list(range(len(xs))), x=xs, **{n: v for n, (_, v) in more.items()})


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None
        else:
            assert g == pytest.approx(w, rel=1e-12, abs=1e-12)


GAPPY = [3.0, None, 1.0, NAN, 10.0, 4.0, 4.0, None, -2.0]
SERIES = pd.Series([np.nan if v is None else v for v in GAPPY])


# cleaning


def test_zscore_uses_sample_std_and_drops_missing(make, step):
    s = SERIES
    kept = s[((s - s.mean()) / s.std()).abs() < 1]
    close(values(step(frame(make, GAPPY), "drop_outliers_zscore", "x", threshold="1"), "x"), list(kept))


def test_zscore_edges(make, step):
    assert step(frame(make, [5.0]), "drop_outliers_zscore", "x").count() == 0  # std of one row is missing
    assert step(frame(make, [3.0, 3.0, 3.0]), "drop_outliers_zscore", "x").count() == 3  # std 0: nothing to drop
    assert step(frame(make, [None, None]), "drop_outliers_zscore", "x").count() == 0


def test_manual_cutoff(make, step):
    close(values(step(frame(make, GAPPY), "drop_outliers_manual", "x", value=4), "x"), [3.0, 1.0, -2.0])
    close(values(step(frame(make, GAPPY), "drop_outliers_manual", "x"), "x"), [-2.0])


def test_manual_cutoff_reaches_the_scan(spark, step, tmp_path, capsys):
    spark.range(10).selectExpr("cast(id as double) as x", "id as y").write.parquet(f"{tmp_path}/t.parquet")
    out = step(spark.read.parquet(f"{tmp_path}/t.parquet"), "drop_outliers_manual", "x", value=3)
    out.select("x").explain()
    plan = capsys.readouterr().out
    assert "LessThan(x,3.0)" in plan and "ReadSchema: struct<x:double>" in plan


def test_drop_duplicates(make, step):
    df = make("x double, k string", 3, x=[1.0, 1.0, None, NAN, None, 2.0], k=["a", "a", None, None, "b", "a"])
    out = step(df, "drop_duplicates")
    assert sorted(map(str, out.collect())) == sorted(
        ["Row(x=1.0, k='a')", "Row(x=None, k=None)", "Row(x=None, k='b')", "Row(x=2.0, k='a')"]
    )


def test_odd_names(make, step):
    df = make("`a.b` double, `a b` string, `n``2.0` double", **{"a.b": [1.0, None], "a b": ["u", "v"], "n``2.0": [1.0, 3.0]})
    assert step(df, "drop_column", "a.b").columns == ["a b", "n`2.0"]
    assert [r[0] for r in step(df, "fill_na_mean", "a.b").collect()] == [1.0, 1.0]
    assert step(df, "one_hot_encode", "a b").columns == ["a.b", "n`2.0", "a b_v"]
    assert [r[2] for r in step(df, "minmax_scaler", "n`2.0").collect()] == [0.0, 1.0]


# imputation


@pytest.mark.parametrize("op,value", [("fill_na_mean", SERIES.mean()), ("fill_na_median", SERIES.median())])
def test_statistic_fill(make, step, op, value):
    close(values(step(frame(make, GAPPY), op, "x"), "x"), list(SERIES.fillna(value)))


def test_mode_fill_takes_smallest_on_ties(make, step):
    ks = ["b", "a", "c", "a", "b", None, None, None]
    assert values(step(frame(make, ks, "string"), "fill_na_mode", "x"), "x")[-1] == "a"
    close(values(step(frame(make, GAPPY), "fill_na_mode", "x"), "x"), list(SERIES.fillna(SERIES.mode()[0])))
    assert values(step(frame(make, [7, None, 7], "int"), "fill_na_mode", "x"), "x") == [7, 7, 7]


@pytest.mark.parametrize("op", ["fill_na_mean", "fill_na_median", "fill_na_mode", "fill_na_knn"])
def test_all_missing_stays_missing(make, step, op):
    assert values(step(frame(make, [None, None]), op, "x"), "x") == [None, None]


@pytest.mark.parametrize(
    "kind,xs,value,want",
    [
        ("double", [1.5, None, NAN], "7", [1.5, 7.0, 7.0]),
        ("long", [1, None], "7", [1, 7]),
        ("long", [1, None], 2.5, [1.0, 2.5]),
        ("double", [1.0, None], "none", ["1.0", "none"]),
        ("string", ["a", None], 0, ["a", "0"]),
        ("boolean", [True, None], "False", [True, False]),
        ("boolean", [True, None], "x", ["True", "x"]),
        ("long", [2**62 + 1, None], 2**62 + 3, [2**62 + 1, 2**62 + 3]),
    ],
)
def test_constant_fill(make, step, kind, xs, value, want):
    assert values(step(frame(make, xs, kind), "fill_na_const", "x", value=value), "x") == want


def group_fill(strategy):
    df = pd.DataFrame({"x": [1.0, np.nan, 3, np.nan, 8, 8, np.nan, np.nan], "g": ["a", "a", "a", "b", "c", "c", None, "c"]})
    by = df.groupby("g")["x"]
    first = (lambda x: x.mode()[0] if len(x.mode()) else np.nan) if strategy == "mode" else strategy
    partly = df["x"].fillna(by.transform(first))
    rest = {"mean": partly.mean, "median": partly.median, "mode": lambda: partly.mode()[0]}[strategy]()
    return df, partly.fillna(rest)


@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_group_fill_then_global_fill(make, step, strategy):
    pdf, want = group_fill(strategy)
    xs = [None if math.isnan(v) else v for v in pdf["x"]]
    df = frame(make, xs, g=("string", list(pdf["g"])))
    close(values(step(df, "fill_na_groupby", "x", group_col="g", strategy=strategy), "x"), list(want))


def test_group_fill_refusals(make, step):
    df = frame(make, ["a", None], "string", g=("string", ["u", "u"]))
    assert values(step(df, "fill_na_groupby", "x", group_col="g", strategy="mode"), "x") == ["a", "a"]
    assert "not numeric" in step(df, "fill_na_groupby", "x", group_col="g")
    assert "unknown strategy" in step(df, "fill_na_groupby", "x", group_col="g", strategy="max")
    assert "not found" in step(df, "fill_na_groupby", "x", group_col="h")


# dates


def test_dates_take_the_main_layout(make, step):
    xs = ["2024-01-01", "01/02/2024", "2024-02-30", "x", None, "2024-2-4"]
    out = step(frame(make, xs, "string"), "extract_date_parts", "x")
    rows = out.orderBy("id").collect()
    assert [str(r["x"])[:10] if r["x"] else None for r in rows] == ["2024-01-01", None, None, None, None, "2024-02-04"]
    assert (rows[0]["x_year"], rows[0]["x_month"], rows[0]["x_day"], rows[0]["x_dow"]) == (2024, 1, 1, 0)
    assert rows[5]["x_dow"] == 6  # Sunday


@pytest.mark.parametrize(
    "text,day",
    [
        ("13/02/2024", "2024-02-13"),
        ("02/13/2024", "2024-02-13"),
        ("2024/02/13", "2024-02-13"),
        ("20240213", "2024-02-13"),
        ("13 Feb 2024", "2024-02-13"),
        ("February 13, 2024", "2024-02-13"),
        ("2024-02-13T05:06:07", "2024-02-13"),
        ("2024-02-13 05:06:07.250", "2024-02-13"),
        ("2024-02-13T23:06:07Z", "2024-02-13"),
    ],
)
def test_layouts(make, step, text, day):
    out = step(frame(make, [text], "string"), "extract_date_parts", "x", drop_original="False")
    assert str(out.first()["x"])[:10] == day


def test_dates_from_other_types(make, step):
    out = step(frame(make, [1_700_000_000_000_000_000], "long"), "extract_date_parts", "x", drop_original="True")
    assert out.columns == ["id", "x_year", "x_month", "x_day", "x_dow"]
    assert tuple(out.first())[1:] == (2023, 11, 14, 1)
    assert step(frame(make, [True], "boolean"), "extract_date_parts", "x").first()["x_year"] is None


# binning and maths


@pytest.mark.parametrize("bins", [1, 2, 5, 7])
@pytest.mark.parametrize("kind", ["normal", "ties", "hot"])
def test_bins_equal_pandas(make, step, bins, kind):
    rng = np.random.default_rng(bins)
    xs = {
        "normal": rng.normal(size=200).round(3),
        "ties": rng.integers(0, 5, size=200).astype(float),
        "hot": np.where(rng.random(200) < 0.5, 1.0, rng.normal(size=200)),
    }[kind]
    df = frame(make, [*map(float, xs), None])
    for strategy, cut in (("quantile", pd.qcut), ("uniform", pd.cut)):
        options = {"duplicates": "drop"} if strategy == "quantile" else {}
        want = list(cut(pd.Series([*xs, np.nan]), bins, labels=False, **options))
        close(values(step(df, "bin_numeric", "x", bins=str(bins), strategy=strategy), "x"), want)


def test_bin_edges(make, step):
    constant = frame(make, [3.0, 3.0])
    assert values(step(constant, "bin_numeric", "x"), "x") == [None, None]
    assert values(step(constant, "bin_numeric", "x", strategy="uniform"), "x") == [2, 2]
    assert values(step(frame(make, [0.0, None]), "bin_numeric", "x", strategy="uniform", labels=None), "x") == [2, -1]
    assert "labels" in step(constant, "bin_numeric", "x", labels="True")
    assert "2 labels" in step(frame(make, [1.0, 2.0, 3.0]), "bin_numeric", "x", bins=3, labels=["a", "b"])
    assert "infinite" in step(frame(make, [1.0, INF]), "bin_numeric", "x", strategy="uniform")


def test_log(make, step):
    xs = [-3.0, 0.0, 2.0, None]
    close(values(step(frame(make, xs), "log_transform", "x"), "x"), [math.log1p(v + 4) for v in xs[:3]] + [None])
    close(values(step(frame(make, [1.0, 2.0]), "log_transform", "x"), "x"), [math.log1p(1), math.log1p(2)])
    close(values(step(frame(make, xs), "log_transform", "x", shift="False"), "x"), [None, 0.0, math.log1p(2), None])


def test_interactions(make, step):
    df = make(
        "id long, a double, b double, s string, big long, one long",
        id=[0, 1, 2],
        a=[1.0, 1.0, NAN],
        b=[0.0, 2.0, 1.0],
        s=["u", "v", None],
        big=[2**63 - 1, 5, 1],
        one=[1, 1, 1],
    )

    def mix(left, sign, right):
        return values(step(df, "create_interaction", "", col1=left, math_op=sign, col2=right, new_name="m"), "m")

    assert mix("a", "/", "b") == [None, 0.5, None]
    assert mix("a", "-", "b") == [1.0, -1.0, None]
    assert mix("big", "+", "one") == [None, 6, 2]
    assert mix("big", "/", "one") == [float(2**63), 5.0, 1.0]
    assert mix("s", "+", "s") == ["uu", "vv", None]
    refused = [
        step(df, "create_interaction", "", col1="s", math_op="*", col2="a", new_name="m"),
        step(df, "create_interaction", "", col1="a", math_op="%", col2="b", new_name="m"),
        step(df, "create_interaction", "", col1="a", math_op="+", col2="zzz", new_name="m"),
    ]
    assert all(r.startswith("skipped") for r in refused)
    assert step(df, "create_interaction", "", col1="a", col2="b", new_name="s").schema["s"].dataType.simpleString() == "double"


def test_time_difference_is_seconds(spark, step):
    df = spark.sql("select timestamp'2024-01-02 00:00:00' a, timestamp'2024-01-01 23:59:58.5' b")
    out = step(df, "create_interaction", "", col1="a", math_op="-", col2="b", new_name="m")
    assert out.first()["m"] == 1.5


def test_polynomials(make, step):
    out = step(frame(make, [2.0, -3.0]), "polynomial_features", "x", degree="3")
    assert [tuple(r)[1:] for r in out.orderBy("id").collect()] == [(2.0, 4.0, 8.0), (-3.0, 9.0, -27.0)]
    assert out.columns == ["id", "x", "x_poly_2", "x_poly_3"]
    assert step(frame(make, [2.0]), "polynomial_features", "x", degree=1).columns == ["id", "x"]
    assert "missing" in step(frame(make, [2.0, None]), "polynomial_features", "x")
    assert "infinite" in step(frame(make, [2.0, INF]), "polynomial_features", "x")
    kept = step(frame(make, [2.0, None]), "polynomial_features", "x", null_policy="propagate", include_degree_1="True")
    assert kept.columns == ["id", "x", "x_poly_1", "x_poly_2"]


# scalers

S = SERIES.dropna()
FORMULAS = {
    "standard_scaler": (SERIES - S.mean()) / S.std(ddof=0),
    "minmax_scaler": (SERIES - S.min()) / (S.max() - S.min()),
    "robust_scaler": (SERIES - S.median()) / (S.quantile(0.75) - S.quantile(0.25)),
    "maxabs_scaler": SERIES / S.abs().max(),
}


@pytest.mark.parametrize("op", FORMULAS)
def test_scalers(make, step, op):
    close(values(step(frame(make, GAPPY), op, "x"), "x"), list(FORMULAS[op]))
    constant = 1.0 if op == "maxabs_scaler" else 0.0
    assert values(step(frame(make, [3.0, 3.0, None]), op, "x"), "x") == [constant, constant, None]
    assert values(step(frame(make, [None, None]), op, "x"), "x") == [None, None]
    assert step(frame(make, []), op, "x").count() == 0
    assert "infinite" in step(frame(make, [1.0, -INF]), op, "x")
    assert "not numeric" in step(frame(make, ["a"], "string"), op, "x")


def test_maxabs_of_zeros(make, step):
    assert values(step(frame(make, [0.0, 0.0]), "maxabs_scaler", "x"), "x") == [0.0, 0.0]


# encoders


@pytest.mark.parametrize("kind,xs", [("string", ["b", "a", None, "c"]), ("double", [2.0, 1.0, None, NAN]), ("boolean", [True, False, None, True])])
def test_one_hot_equals_pandas(make, step, kind, xs):
    pdf = pd.DataFrame({"id": range(4), "x": pd.Series(xs, dtype=float if kind == "double" else object)})
    want = pd.get_dummies(pdf, columns=["x"], drop_first=True)
    out = step(frame(make, xs, kind), "one_hot_encode", "x")
    assert out.columns == list(want.columns)
    assert [list(r) for r in out.orderBy("id").collect()] == want.values.tolist()


def test_one_hot_refuses_very_wide_tables(spark, make, step):
    df = frame(make, [str(i) for i in range(20)], "string")
    assert "more than 10 categories" in step(df, "one_hot_encode", "x", max_columns=10)
    assert len(step(df, "one_hot_encode", "x", max_columns=20).columns) == 20
    many = spark.range(1_200).select(F.concat(F.lit("v"), "id").alias("x"))
    assert len(step(many, "one_hot_encode", "x").columns) == 1_199


def test_wide_categories_become_codes(spark, make, monkeypatch):
    df = make("id long, a string, b string, x double", id=[0, 1, 2, 3], a=["q", None, "p", "r"], b=["z", "y", None, "z"], x=[1.0, 2.0, 2.0, None])
    one = fit_recipe(df, Recipe.of(("one_hot_encode", "a", {"form": "codes"})))
    assert one.output.columns == ["id", "b", "x", "a_codes"]
    assert [r["a_codes"] for r in one.output.orderBy("id").collect()] == [[0], [], [], [1]]
    numbers = fit_recipe(df, Recipe.of(("one_hot_encode", "x", {"form": "codes"})))
    assert [r["x_codes"] for r in numbers.output.orderBy("id").collect()] == [[], [0], [0], []]
    both = transform_table(df, Recipe([]), form="codes")
    assert both.output.columns == ["id", "x", "dummy_codes"]
    assert [r["dummy_codes"] for r in both.output.orderBy("id").collect()] == [[1, 4], [3], [0], [2, 4]]
    names = both.fitted.tables["dummy_codes"].orderBy("code").collect()
    assert [tuple(r) for r in names] == [(0, "a", "p", 1), (1, "a", "q", 1), (2, "a", "r", 1), (3, "b", "y", 1), (4, "b", "z", 2)]
    new = both.fitted.transform(df)  # the dummies are no step of the recipe
    assert new.columns == df.columns
    monkeypatch.setattr(encoding, "DENSE_COLUMNS", 4)  # what does not fit turns to codes by itself
    assert transform_table(df, Recipe([])).output.columns == ["id", "x", "dummy_codes"]
    monkeypatch.setattr(encoding, "DENSE_COLUMNS", 1)
    assert "too many for columns" in fit_recipe(df, Recipe.of(("one_hot_encode", "a", {"form": "columns"}))).results[0].reason
    monkeypatch.setattr(encoding, "DENSE_COLUMNS", 2)
    assert fit_recipe(df, Recipe.of(("one_hot_encode", "a"))).output.columns == ["id", "b", "x", "a_q", "a_r"]
    empty = transform_table(df.limit(0), Recipe([]), form="codes")
    assert empty.output.columns == ["id", "x", "dummy_codes"] and empty.output.count() == 0 and empty.fitted.tables["dummy_codes"].count() == 0


def test_codes_use_a_free_name_and_equal_columns(spark, make):
    rows = [f"v{i % 37}" for i in range(300)]
    df = make("id long, x string, x_codes string", id=list(range(300)), x=rows, x_codes=["k"] * 300)
    out = fit_recipe(df, Recipe.of(("one_hot_encode", "x", {"form": "codes"}))).output
    assert out.columns == ["id", "x_codes", "x_codes_"]
    dense = fit_recipe(df.drop("x_codes"), Recipe.of(("one_hot_encode", "x"))).output
    flags = {r["id"]: [i for i, f in enumerate(r[1:]) if f] for r in dense.collect()}
    assert {r["id"]: r["x_codes_"] for r in out.collect()} == flags


def test_batch_writes_the_code_table(spark, make, tmp_path):
    df = make("id long, x string", id=[1, 2], x=["b", "a"])
    for end in (".parquet", ".csv"):
        source, target = f"{tmp_path}/in{end}", f"{tmp_path}/out{end}"
        write_table(df, source)
        run_batch(spark, source, Recipe([]), target, form="codes")
        assert sorted(str(r["dummy_codes"]).strip("[]") for r in read_table(spark, target).collect()) == ["0", "1"]
        assert sorted(r["value"] for r in read_table(spark, codes_path(target, "dummy_codes")).collect()) == ["a", "b"]


def test_day_and_month_by_all_values(make, step):
    """Shapes, field maxima and exact counts agree with trying every layout on every value."""
    columns = [
        ["1/2/2024", "11/12/2024"], ["1/2/2024", "13/12/2024"], ["13/1/2024", "1/13/2024", "1/14/2024"], ["40/1/2024", "1/2/2024"], ["1/2/2024", "2024-01-05", "2024-01-06"],
        ["2024-99-99", "2024-01-01"], ["5 May 2024", "6 Mai 2024"], ["May 5, 2024", "March 5, 2024"], ["99/99/2024", "31/12/2024", "2/30/2024"], ["x1", "20240105"],
    ]
    for texts in columns:
        df = make("d string", d=texts)
        counts = df.agg(*[F.count(dates.read(F.trim("d"), x)) for x in dates.FORMATS]).first()
        assert dates.find_layout(df, "d") == dates.FORMATS[list(counts).index(max(counts))], texts
    assert dates.find_layout(make("d string", d=["99/99/9999", "id 7"]), "d") is None


@pytest.mark.parametrize(
    "kind,xs,want",
    [
        ("string", ["b", None, "a", "z"], [1, 2, 0, 3]),  # missing is the text 'nan'
        ("long", [2, 10, 1, 2], [2, 1, 0, 2]),  # numbers sort as text
        ("double", [1e16, 1.0, 1e-5, NAN], [1, 0, 2, 3]),  # 1.0 < 1e+16 < 1e-05 < nan
        ("boolean", [True, False, None, True], [1, 0, 2, 1]),
    ],
)
def test_label_encode(make, step, kind, xs, want):
    assert values(step(frame(make, xs, kind), "label_encode", "x"), "x") == want


@pytest.mark.parametrize(
    "kind,xs,want",
    [
        ("string", ["b", None, "a"], [1.0, None, 0.0]),
        ("long", [10, 2, None], [1.0, 0.0, None]),
        ("double", [10.0, 2.0, NAN], [1.0, 0.0, None]),
    ],
)
def test_ordinal_encode(make, step, kind, xs, want):
    assert values(step(frame(make, xs, kind), "ordinal_encode", "x"), "x") == want


def test_target_encode(make, step):
    sizes = {"one": 1, "twenty": 20, "hundred": 100, None: 5}
    keys = [k for k, n in sizes.items() for _ in range(n)]
    rng = np.random.default_rng(0)
    ys = list(map(float, rng.normal(10, 3, size=len(keys))))
    ys[5] = None
    df = frame(make, keys, "string", y=("double", ys))
    pdf = pd.DataFrame({"k": keys, "y": pd.Series(ys, dtype=float)})
    prior, want = pdf["y"].mean(), []
    for k in keys:
        y = pdf["y"][pdf["k"].isna() if k is None else pdf["k"] == k].dropna()
        s = 1 / (1 + math.exp(-(len(y) - 20) / 10))
        want.append(prior * (1 - s) + y.mean() * s)
    close(values(step(df, "target_encode", "x", target_col="y"), "x"), want)
    assert "not numeric" in step(df, "target_encode", "y", target_col="x")
    assert "not found" in step(df, "target_encode", "x", target_col="nope")


def test_double_text_is_python_text(spark):
    rng = np.random.default_rng(1)
    numbers = [0.0, -0.0, 1.0, 1e7, 1e15, 123456789.125, 1e16, -1e16, 1.5e300, 1e-4, 1e-5, -2.5e-7, 0.001, 0.00123, 1e100, INF, -INF]
    # Java before 19 prints a few values beyond 1e17 with one digit too many.
    numbers += [float(f"{m:.6f}e{e}") for m, e in zip(rng.uniform(-9.9, 9.9, 300), rng.integers(-12, 18, 300))]
    df = spark.createDataFrame([(n, repr(n)) for n in numbers], "x double, t string")
    wrong = df.withColumn("mine", double_text(F.col("x"))).where("mine <> t").collect()
    assert wrong == []


DATES = ["12/1/2010 8:26", "1/2/24", "01-Jan-2024", "2024-01", "2024-01-05 10:30:00 AM", "Mon, 01 Jan 2024 10:00:00", "2024-01-05 10:30:00+00:00"]


@pytest.mark.parametrize("text", DATES)
def test_date_layouts_pandas_reads(make, step, text):
    row = step(make("d string", d=[text, text, None]), "extract_date_parts", "d").where("d is not null").first()
    want = pd.to_datetime(text)
    assert (row["d_year"], row["d_month"], row["d_day"], row["d_dow"]) == (want.year, want.month, want.day, want.dayofweek)


def test_unreadable_dates_are_refused(make, step):
    assert step(make("d string", d=["x", "y"]), "extract_date_parts", "d", drop_original="True").startswith("skipped: no date layout")


def test_integers_without_gaps_stay_exact(make, step):
    df = make("x long, g string", x=[9007199254740993, 1], g=["a", "b"])
    for operation, params in (("fill_na_mean", {}), ("fill_na_median", {}), ("fill_na_groupby", {"group_col": "g", "strategy": "mean"})):
        out = step(df, operation, "x", **params)
        assert sorted(r["x"] for r in out.collect()) == [1, 9007199254740993]


def test_unusable_constant_for_times(make, step):
    df = make("d string", d=["2024-01-01", None]).select(F.to_timestamp("d").alias("d"))
    assert step(df, "fill_na_const", "d", value="soon").startswith("skipped")
    assert step(df, "fill_na_const", "d", value="2024-02-01").where("d is null").isEmpty()


def test_truth_values_in_interactions(make, step):
    df = make("a boolean, b boolean, x double", a=[True, False, None], b=[True, True, True], x=[2.0, 3.0, 4.0])
    got = lambda **p: [r["z"] for r in step(df, "create_interaction", "", new_name="z", **p).orderBy("x").collect()]
    assert got(col1="a", math_op="*", col2="x") == [2.0, 0.0, None]
    assert got(col1="b", math_op="+", col2="x") == [3.0, 4.0, 5.0]
    assert got(col1="a", math_op="*", col2="b") == [True, False, None]
    assert step(df, "create_interaction", "", col1="a", math_op="-", col2="b", new_name="z").startswith("skipped")


@pytest.mark.parametrize("kind", ["int", "long", "double"])
def test_outlier_limits_reach_the_scan(spark, step, tmp_path, kind):
    path = str(tmp_path / kind)
    spark.range(100).select(F.col("id").cast(kind).alias("x")).write.parquet(path)
    out = step(spark.read.parquet(path), "drop_outliers_manual", "x", value=9.5)
    assert out.count() == 10
    assert "LessThan(x" in out._jdf.queryExecution().toString()


def test_unseen_category_gets_the_prior(make):
    from sparkprep import Recipe, fit_recipe

    df = make("k string, y double", k=["a", "a", "b"], y=[1.0, 2.0, 6.0])
    fitted = fit_recipe(df, Recipe.of(("target_encode", "k", {"target_col": "y"})))
    assert fitted.transform(make("k string, y double", k=["new"], y=[0.0])).first()["k"] == 3.0
    fitted.release()


def test_interaction_never_replaces_another_case(make, step):
    df = make("a double, b double", a=[1.0], b=[2.0])
    assert "would replace" in step(df, "create_interaction", col1="a", math_op="+", col2="b", new_name="A")
    assert step(df, "create_interaction", col1="a", math_op="+", col2="b", new_name="a").first()["a"] == 3.0
