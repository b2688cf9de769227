"""The order of rows in files against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import sparkprep as sp
from sparkprep.plans.preview import head_sample
from sparkprep.sources.order import first_files

FILES = 6


@pytest.fixture(params=["parquet", "csv"])
def files(request, spark, tmp_path):
    """A table in several files of different lengths, one empty, and the same in pandas."""
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"x": rng.integers(0, 5, n), "k": rng.choice(["a", "b", "c"], n)}) for n in (40, 0, 7, 300, 1, 90)]
    folder = tmp_path / f"t.{request.param}"
    folder.mkdir()
    for i, part in enumerate(parts):
        path = f"{folder}/part-{i}.{request.param}"
        part.astype({"x": "int64"}).to_parquet(path) if request.param == "parquet" else part.to_csv(path, index=False)
    whole = pd.concat(parts, ignore_index=True).astype({"x": "int64"})
    return sp.read_table(spark, str(folder)), whole


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain(pdf):
    return [(int(x), k, *rest) for x, k, *rest in pdf.itertuples(index=False)]


def test_row_numbers(files):
    df, pdf = files
    found = sp.with_row_numbers(df).orderBy("row")
    assert rows(found) == plain(pdf.assign(row=range(len(pdf))))


@pytest.mark.parametrize("n", [0, 1, 40, 45, 47, 400, 1000])
def test_head(files, n):
    df, pdf = files
    assert rows(head_sample(df, n)) == plain(pdf.head(n))


def test_keep_first(files):
    df, pdf = files
    numbered = sp.with_row_numbers(df)
    out = sp.apply_recipe(numbered, sp.Recipe.of(("drop_duplicates", "", {"position": "row"})))
    assert rows(out.orderBy("row")) == plain(pdf.assign(row=range(len(pdf))).drop_duplicates(["x", "k"]))


@pytest.mark.parametrize("limit", [None, 0])
def test_keep_first_when_few_or_many_repeat(make, monkeypatch, limit):
    from sparkprep.functions import lookup

    if limit is not None:
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    df = make("x double, k string, at long", 3, x=[1.0, 1.0, None, float("nan"), 0.0, -0.0, 2.0], k=["a", "a", None, None, "z", "z", "a"], at=[5, 4, 9, 8, 3, 7, 1])
    out = sp.apply_recipe(df, sp.Recipe.of(("drop_duplicates", "", {"position": "at"})))
    assert sorted(rows(out), key=str) == sorted([(1.0, "a", 4), (None, None, 8), (0.0, "z", 3), (2.0, "a", 1)], key=str)
    assert out.columns == ["x", "k", "at"]


def test_preview_keeps_the_files_order(files):
    df, pdf = files
    recipe = sp.Recipe.of(("drop_duplicates", ""), ("minmax_scaler", "x"))
    page = sp.preview(df, recipe, n=200, show=9)
    head = pdf.head(200).drop_duplicates()
    scaled = head.assign(x=(head.x - head.x.min()) / (head.x.max() - head.x.min()))
    assert page.columns == ["x", "k"] and page.rows == len(head)
    assert rows(page.data) == [tuple(r) for r in scaled.head(9).itertuples(index=False)]
    assert [r.step for r in page.fitted.results] == list(recipe.steps)
    assert page.fitted.transform(df).columns == ["x", "k"]
    assert page.fitted.schema == df.schema


def test_filtered_rows_keep_their_order(files):
    df, pdf = files
    found = [r["x"] for r in sp.with_row_numbers(df.where("x < 3")).orderBy("row").collect()]
    assert found == list(pdf.x[pdf.x < 3])


def test_a_head_opens_the_first_files_only(spark, tmp_path):
    spark.range(0, 80, 1, 8).write.parquet(f"{tmp_path}/t.parquet")
    df = spark.read.parquet(f"{tmp_path}/t.parquet")
    assert len(df.inputFiles()) == 8
    assert first_files(df, 15).select("_metadata.file_path").distinct().count() == 2
    assert first_files(df, 1000).count() == 80


def test_frames_without_files(spark):
    df = spark.range(10)
    assert head_sample(df, 4).count() == 4
    with pytest.raises(ValueError):
        sp.with_row_numbers(df)
    with pytest.raises(ValueError):
        sp.with_row_numbers(df, "id")


def test_an_own_column_called_metadata(spark, tmp_path):
    spark.range(0, 30, 1, 3).selectExpr("id", "'x' as _metadata").write.parquet(f"{tmp_path}/t.parquet")
    found = sp.with_row_numbers(spark.read.parquet(f"{tmp_path}/t.parquet"))
    assert rows(found.orderBy("row").select("id", "row")) == [(i, i) for i in range(30)]
    assert found.where(F.col("_metadata") != "x").isEmpty()


def test_records_joined_from_blocks_have_no_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,k\n" + "".join(f'{i},"a\nb"\n' for i in range(10)))
    df = sp.read_table(spark, f"{tmp_path}/t.csv")
    assert head_sample(df, 4).count() == 4 and sp.preview(df, sp.Recipe([]), n=4).rows == 4
    with pytest.raises(ValueError):
        sp.with_row_numbers(df)
