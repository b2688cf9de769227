"""Format choice and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkprep.sources.csv import read_csv, write_csv


def is_parquet(path: str) -> bool:
    return path.rstrip("/").endswith(".parquet")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder named ``*.parquet``, else CSV."""
    return spark.read.parquet(path) if is_parquet(path) else read_csv(spark, path)


def write_table(df: DataFrame, path: str) -> None:
    if is_parquet(path):
        df.write.mode("errorifexists").parquet(path)
    else:
        write_csv(df, path)
