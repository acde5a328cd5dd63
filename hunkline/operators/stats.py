"""Per-file and per-change-set statistics, token estimate and the size test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkline.functions import estimate_tokens

# The reference's "large diff" thresholds (strict >).
MAX_FILES = 50
MAX_CHANGES = 500
MAX_TOKENS = 15000


def _sum_field(files: Column, field: str) -> Column:
    return F.aggregate(files, F.lit(0).cast("bigint"), lambda acc, f: acc + f[field])


def stats_cols(files: Column) -> list[Column]:
    """Files, additions, deletions; all zero for no files (see ``with_stats``)."""
    adds = _sum_field(files, "additions")
    dels = _sum_field(files, "deletions")
    return [
        F.size(files).cast("bigint").alias("total_files"),
        adds.alias("total_additions"),
        dels.alias("total_deletions"),
    ]


def with_stats(df: DataFrame, files_col: str = "files") -> DataFrame:
    """Adds total_files/additions/deletions, then total_changes in a later project."""
    return (df.select("*", *stats_cols(F.col(files_col)))
              .withColumn("total_changes", F.col("total_additions") + F.col("total_deletions")))


def is_large_col(total_files: Column, total_changes: Column, diff_tokens: Column,
                 max_files: int = MAX_FILES, max_changes: int = MAX_CHANGES,
                 max_tokens: int = MAX_TOKENS) -> Column:
    """Strict ``>`` on each threshold, as the code does (not the docs' ``50+``)."""
    return (total_files > max_files) | (total_changes > max_changes) | (diff_tokens > max_tokens)


def with_is_large(df: DataFrame, diff_col: str = "diff", **thresholds) -> DataFrame:
    """Needs ``total_files``/``total_changes``; adds ``diff_tokens`` and ``is_large``."""
    return (df.withColumn("diff_tokens", estimate_tokens(diff_col))
              .withColumn("is_large", is_large_col(F.col("total_files"), F.col("total_changes"),
                                                   F.col("diff_tokens"), **thresholds)))


def rollup_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum change-set statistics by ``keys`` (partial aggregation map-side)."""
    return (df.groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n_changesets"),
                   F.sum("total_files").cast("bigint").alias("total_files"),
                   F.sum("total_additions").cast("bigint").alias("total_additions"),
                   F.sum("total_deletions").cast("bigint").alias("total_deletions"),
                   F.sum("total_changes").cast("bigint").alias("total_changes"),
                   F.count_if(F.col("is_large")).cast("bigint").alias("n_large")))
