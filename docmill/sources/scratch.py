"""Derived tables written once in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docmill.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: computed once,
    read by every later use, and still there when an executor is lost.
    ``docmill.session.remove_scratch`` deletes an application's tables."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
