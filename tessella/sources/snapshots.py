"""The shared folder, and tables written there to end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.errors import QueryError


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a session within one machine (as in tests) gets
    one of its own; a cluster has no folder that all executors see, which is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import re
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise QueryError("set spark.checkpoint.dir to a folder that all executors share")

        where = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
