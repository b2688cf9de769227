"""A corpus pipeline: toxic documents out, repeated lines out, one of each near-duplicate, mixed to targets, encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import bpe, line_dedup, mixing, simhash, toxicity
from sparkprep.llm.queries import TARGETS, byte_bpe
from sparkprep.session import required_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A network, a 64-bit hash and rank merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the network rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, up to one edit, go; every document stays, if need be empty."""
    lean = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return lean.select("doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints stays."""
    return simhash.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by their calibrated probability, none twice."""
    return mixing.mix(docs.select(*COLUMNS), TARGETS).where("kept").select("row.*").select(*COLUMNS)


def mix_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as are given, in copies by weight: a row of a scarce cell comes several times."""
    mixed = mixing.mix(docs.select(*COLUMNS), TARGETS).where("copies > 0")
    return mixed.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as digests, with those of the decoded bytes."""
    return bpe.round_trip(docs, **byte_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: The same with a corpus that keeps its tokens; one document can have several rows.
STAGES_WITH_COPIES = [(name, mix_copies if stage is mix_sources else stage) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str, stages: list | None = None) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{required_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for place, (name, stage) in enumerate(stages or STAGES):
        path = f"{folder}/{place}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
