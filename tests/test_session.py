from sparkprep import Recipe, fit_recipe
from sparkprep.session import cut_lineage, shared_folder


def test_the_session_names_the_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cut_lineage_keeps_names_and_rows(spark):
    df = spark.sql("select 1 as `a.b`, 'x' as `a b`, 2.5d as `n_2.0`, true as `k,(v)`, timestamp'2024-01-01' as `t=`")
    back = cut_lineage(df)
    assert back.columns == df.columns and back.collect() == df.collect()
    both = spark.sql("select 1 as a, 2 as A")
    assert tuple(cut_lineage(both).first()) == (1, 2)


def test_a_cut_frame_prunes_columns(spark, capsys):
    df = spark.range(20).selectExpr("id % 5 as k", "cast(id % 5 as double) as x", "'t' as t")
    fitted = fit_recipe(df, Recipe.of(("drop_duplicates", ""), ("standard_scaler", "x")))
    assert fitted.output.count() == 5
    fitted.output.select("x").explain()
    assert "ReadSchema: struct<x:double>" in capsys.readouterr().out
