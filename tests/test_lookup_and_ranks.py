import pytest
from pyspark.sql import functions as F

from sparkprep.functions import lookup
from sparkprep.functions.lookup import Kept, fits_broadcast, lookup_join
from sparkprep.functions.ranks import passed, running_start


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_large_tables_join_like_small_ones(spark, monkeypatch, null_safe, how):
    """The split into heavy and light keys gives what one broadcast gives."""
    monkeypatch.setattr(lookup, "HEAVY_SHARE", 10)
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    df = spark.range(2_000).select("id", key.alias("k")).repartition(6)
    table = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")).where("k is null or k <> 'k5'")
    kept = Kept()

    def rows(small):
        out = lookup_join(df, table, {"k": F.col("k")}, "n", kept, how=how, null_safe=null_safe, small=small)
        return sorted(out.select("id", "k", "s", "n").collect(), key=lambda r: r["id"])

    assert rows(False) == rows(True)
    assert len(rows(True)) == 2_000 or how == "inner"
    kept.release()


def test_size_check(spark, monkeypatch):
    df = spark.range(100).withColumn("t", F.repeat(F.lit("x"), 1_000))
    assert fits_broadcast(df)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 50_000)
    assert not fits_broadcast(df)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 1 << 30)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 99)
    assert not fits_broadcast(df)


@pytest.mark.parametrize("range_rows", [10_000, 50])
def test_running_start(spark, range_rows):
    df = spark.range(1, 1_001).select(F.concat(F.lit("v"), F.lpad("id", 5, "0")).alias("v"), (F.col("id") % 5).alias("w"))
    out = running_start(df.repartition(7), "v", F.col("w"), range_rows).orderBy("v").collect()
    total = 0
    for r in out:
        assert r["start"] == total
        total += r["w"]
    assert len(out) == 1_000


@pytest.mark.parametrize("count", [0, 1, 2, 7, 1_000])
def test_passed_bounds(spark, count):
    bounds = [float(3 * i) for i in range(count)]
    df = spark.range(-5, 3 * count + 5).select(F.col("id").cast("double").alias("x"))
    for r in df.select("x", passed(bounds, F.col("x")).alias("n")).collect():
        assert r["n"] == sum(r["x"] >= b for b in bounds)


def test_codes_need_no_shared_folder(spark, monkeypatch):
    """More values than one range holds, on a session that names no folder."""
    from sparkprep import Recipe, fit_recipe
    from sparkprep import session

    monkeypatch.setattr(session, "shared_folder", lambda spark: None)
    df = spark.range(150_000).select(F.concat(F.lit("v"), F.lpad("id", 7, "0")).alias("k"), "id")
    fitted = fit_recipe(df, Recipe.of(("label_encode", "k")))
    assert [r.status for r in fitted.results] == ["applied"]
    assert fitted.output.where("k <> id").isEmpty()
    fitted.release()


def test_heavy_keys_too_long_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 64)
    keys = ["k" * 200, "m" * 200, "n"]
    df = spark.createDataFrame([(keys[i % 3], i) for i in range(30)] + [(None, 99)], "k string, i long")
    table = df.groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("top")).where("k is not null")
    kept = Kept()
    out = lookup_join(df, table, {"k": F.col("k")}, "c", kept)
    got = {r["i"]: r["top"] for r in out.collect()}
    assert got == {i: 27 + i % 3 for i in range(30)} | {99: None}
    kept.release()
