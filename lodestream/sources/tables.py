"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
