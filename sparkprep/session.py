"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan in the package relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder for checkpoints and written intermediates.

    It is whatever ``spark.checkpoint.dir`` names.  Only a local session without
    that setting gets a folder of its own; a cluster without it gets ``None``,
    because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="sparkprep-")
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def required_folder(spark: SparkSession) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def cut_lineage(df: DataFrame, required: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Later jobs start from the copy, prune its columns, and survive lost
    executors.  The copy stays under the folder's retention rules, like any
    checkpoint.  Without a shared folder the frame is returned as it is, unless
    the caller cannot do without.
    """
    spark = df.sparkSession
    folder = required_folder(spark) if required else shared_folder(spark)
    if folder is None:
        return df
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names) or not names:  # names Parquet cannot tell apart
        return df.checkpoint()
    path = f"{folder}/sparkprep-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)
