"""Incremental processing of change-sets (K1) and request de-duplication (K2).

K1 is stateless: parsing, statistics, routing and the summary are row-local
expressions, so the streaming plan is the batch plan (append mode, no state
store). K2 keeps state bounded by a watermark.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.operators.compact import process_diffs
from hunkline.schema import CHANGESETS
from hunkline.session import checkpoint_dir

PROCESSED_COLUMNS = ["changeset_id", "total_files", "total_additions", "total_deletions",
                     "total_changes", "estimated_tokens", "was_compacted", "content_md5"]


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "hunkline", *parts, uuid.uuid4().hex)


def processed_view(df: DataFrame) -> DataFrame:
    """The flagship columns (row-local, so valid inside a streaming plan)."""
    return process_diffs(df).select(
        "changeset_id", "total_files", "total_additions", "total_deletions", "total_changes",
        F.col("diff_tokens").alias("estimated_tokens"), "was_compacted",
        F.md5("content").alias("content_md5"))


def process_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                   max_files_per_trigger: int | None = None):
    """K1: ``readStream`` change-set parquet -> the batch operator -> a parquet file
    sink. Append mode without state: each arriving diff is read and parsed once.
    The sink's log makes a retried batch idempotent, the checkpoint makes a restart
    resume where it stopped; ``availableNow`` drains what has arrived and stops."""
    reader = spark.readStream.schema(CHANGESETS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (processed_view(reader.parquet(source_dir)).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_dir))


def request_keys(requests: DataFrame, changesets: DataFrame) -> DataFrame:
    """Attach ``diff_sha`` (content key) to requests. Only the narrow
    ``(changeset_id, repo, sha)`` side is computed from the diff text."""
    keys = changesets.select("changeset_id", "repo", F.sha2("diff", 256).alias("diff_sha"))
    return requests.join(keys, "changeset_id", "left")


def dedupe_requests(requests: DataFrame, window: str = "10 minutes") -> DataFrame:
    """K2 (batch and streaming): one kept request per ``(repo, diff_sha)`` and
    tumbling ``window`` of ``ts``; later ones in the window are suppressed. A
    request without repository or content is like no other request."""
    w = F.window("ts", window)
    unknown = F.when(F.col("repo").isNull() | F.col("diff_sha").isNull(), F.col("request_id"))
    return (requests.withWatermark("ts", window)
                    .groupBy("repo", "diff_sha", unknown.alias("unknown"), w.alias("w"))
                    .agg(F.min_by("request_id", F.struct("ts", "request_id")).alias("kept_request"),
                         F.count(F.lit(1)).alias("n_requests"))
                    .select("repo", "diff_sha",
                            F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                            "kept_request", "n_requests",
                            (F.col("n_requests") - 1).alias("n_suppressed")))


def suppress_repeats_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """K2 streaming form: drop a request whose ``(repo, diff_sha)`` was seen
    within ``delay`` (state expires with the watermark). A request without
    repository or content is never a repeat."""
    unknown = F.when(F.col("repo").isNull() | F.col("diff_sha").isNull(), F.col("request_id"))
    return (requests.withColumn("_unknown", unknown).withWatermark("ts", delay)
                    .dropDuplicatesWithinWatermark(["repo", "diff_sha", "_unknown"]).drop("_unknown"))


REQUESTS = "request_id STRING, repo STRING, diff_sha STRING, ts TIMESTAMP"


def suppress_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, delay: str = "10 minutes"):
    """K2 as a job: requests that have arrived as parquet since the last run, without
    those that repeat a kept one. A kept request is remembered in the state store until
    the watermark (the latest request of earlier runs, less ``delay``) passes its time by
    ``delay``; a request older than the watermark is late and dropped. State, watermark and
    what was read are in the checkpoint, so a restarted job goes on where it stopped."""
    stream = spark.readStream.schema(REQUESTS).parquet(source_dir)
    return (suppress_repeats_stream(stream, delay).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink_dir))


def staged_copy(df: DataFrame, spark: SparkSession, name: str) -> str:
    """Write ``df`` as a parquet table under the shared folder; return its path."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path

