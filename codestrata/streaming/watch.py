"""Structured Streaming over arriving sources: files are parsed as they come, counts are kept by batch and summed when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import parse

SCHEMA = "repo_id string, path string, content string"


def parsed_stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """File records of parquet rows that arrive below a path."""
    return parse.parse_files(spark.readStream.schema(schema).parquet(path))


def running_stats(stream: DataFrame, checkpoint: str, out: str):
    """A query that adds each batch's statistics to a table and ends when all that is there is read. A batch that runs again replaces its own rows."""

    def add(batch: DataFrame, number: int) -> None:
        parse.project_stats(parse.records(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stats(spark: SparkSession, out: str) -> DataFrame:
    """Statistics of all batches so far."""
    counts = ["files", *[f"n_{k}" for k in parse.COUNTED]]
    return spark.read.parquet(out).groupBy("repo_id").agg(*[F.sum(c).alias(c) for c in counts])
