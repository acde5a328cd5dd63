"""Read the driver's parquet tables with explicit schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from hunkline.schema import CHANGESETS, DRIVER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: scan one driver table; the schema is declared, never inferred."""
    return spark.read.schema(DRIVER[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def changesets(spark: SparkSession, path: str) -> DataFrame:
    """A1: scan a stored ``changesets(repo, changeset_id, diff)`` table."""
    return spark.read.schema(CHANGESETS).parquet(path)
