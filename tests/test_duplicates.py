import pytest
from pyspark.sql import functions as F

from sparkprep.functions import duplicates, lookup
from sparkprep.functions.lookup import Kept


@pytest.mark.parametrize("limit", [500_000, 3])
@pytest.mark.parametrize("collide", [False, True])
def test_every_path(spark, monkeypatch, limit, collide):
    """Few or many repeated hashes, and hashes that collide, give the same rows."""
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", limit)
    if collide:
        monkeypatch.setattr(duplicates, "_row_hash", lambda df: F.col("id") % 2)
    df = spark.range(300).select((F.col("id") % 290).alias("id"), F.when(F.col("id") % 3 > 0, 1.0).alias("x"))
    df = df.unionByName(spark.range(100).select(F.lit(7).cast("long").alias("id"), F.lit(float("nan")).alias("x")))
    df = df.repartition(5)
    want = {(r["id"], None if r["x"] != r["x"] else r["x"]) for r in df.collect()}
    kept = Kept()
    got = [tuple(r) for r in duplicates.without_duplicates(df, kept).collect()]
    assert set(got) == want and len(got) == len(want)
    assert duplicates.count_duplicates(df) == 400 - len(want)
    kept.release()


def test_no_duplicates(spark):
    df = spark.range(50).withColumn("k", F.lit("a"))
    assert duplicates.count_duplicates(df) == 0
    assert duplicates.without_duplicates(df, Kept()).count() == 50
