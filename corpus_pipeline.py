"""A training-corpus pipeline of five operators, each over all that the stage before kept.

STAGES: (name, function of (spark, docs, sf_dir) -> DataFrame). All but the last return the
columns of `documents`; the last returns each row's shard. The mixing stage is lossless: it
repeats rows of small sources within the repetition limit and drops none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import decontaminate, minhash, mixing, sharding, toxicity
from codestrata.llm.shared import written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    return minhash.keep_one(spark, docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go; one item is enough."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the proportions of the tempered source weights."""
    return mixing.mixed(spark, docs).select("row.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its shard."""
    return sharding.assign(spark, docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model decides in the first stage, so SQL cannot express the rows.
ORACLE_SQL = None
