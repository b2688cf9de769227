import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from sparkprep.session import tune

    yield tune(session)
    session.stop()


@pytest.fixture
def make(spark):
    """A frame from column lists: ``make("x double, k string", x=[...], k=[...])``."""

    def build(schema: str, partitions: int | None = None, **columns):
        names = [c.strip().rsplit(" ", 1)[0].strip("`") for c in schema.split(",")]
        df = spark.createDataFrame(list(zip(*[columns[n] for n in names])), schema)
        return df.repartition(partitions) if partitions else df

    return build


@pytest.fixture
def step(spark):
    """Applies one operation; returns the sorted rows, or the skip reason."""
    from sparkprep import Recipe, fit_recipe

    def run(df, operation, column="", **params):
        fitted = fit_recipe(df, Recipe.of((operation, column, params)))
        result = fitted.results[0]
        fitted.release()
        if result.status != "applied":
            return f"{result.status}: {result.reason}"
        return fitted.output

    return run
