"""Shared folder handling: lineage is cut by parquet tables every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and master is local (tests, one machine) a folder of this machine
    is made, one an application; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own.get(context.applicationId)
        if named is None:
            named = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return named.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str, **options: object) -> DataFrame:
    """df as a parquet table in the shared folder: survives lost executors, is computed once. options: the writer's."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo modulus (null id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
