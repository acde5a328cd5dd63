"""Batch equals availableNow streaming (K1); de-duplication (K2)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF001
from hunkline.sources.fixtures import doc_changesets
from hunkline.streaming.incremental import (PROCESSED_COLUMNS, dedupe_requests, processed_view,
                                            process_stream, scratch_path,
                                            staged_copy, suppress_repeats_stream, suppress_stream)


def test_stream_equals_batch(spark):
    cs = doc_changesets(spark, SF001)
    src = staged_copy(cs, spark, "t_src")
    out, ck = scratch_path(spark, "t_out"), scratch_path(spark, "t_ck")
    process_stream(spark, src, out, ck, max_files_per_trigger=1).awaitTermination()
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select(*PROCESSED_COLUMNS).collect())
    batch = sorted(tuple(r) for r in processed_view(cs).collect())
    assert streamed == batch and len(batch) > 0


def test_dedupe_window(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("r1", t0, "a", "s1"), ("r2", t0 + dt.timedelta(minutes=3), "a", "s1"),
            ("r3", t0 + dt.timedelta(minutes=12), "a", "s1"), ("r4", t0, "a", "s2")]
    df = spark.createDataFrame(rows, "request_id STRING, ts TIMESTAMP, repo STRING, diff_sha STRING")
    got = {(r.diff_sha, r.window_start): (r.kept_request, r.n_suppressed)
           for r in dedupe_requests(df).collect()}
    assert got == {("s1", "2024-01-01 00:00:00"): ("r1", 1), ("s1", "2024-01-01 00:10:00"): ("r3", 0),
                   ("s2", "2024-01-01 00:00:00"): ("r4", 0)}


def test_unknown_requests_suppress_nothing(spark):
    df = spark.createDataFrame([("r1", None, None), ("r2", None, None), ("r3", "a", None), ("r4", "a", "s"), ("r5", "a", "s")],
                               "request_id STRING, repo STRING, diff_sha STRING").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS ts")
    assert sorted(r.kept_request for r in dedupe_requests(df).collect()) == ["r1", "r2", "r3", "r4"]


def test_suppress_repeats_streaming(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [("r1", t0, "a", "s1"), ("r2", t0 + dt.timedelta(minutes=3), "a", "s1"),
            ("r3", t0, "b", "s1")]
    src = scratch_path(spark, "t_req")
    spark.createDataFrame(rows, "request_id STRING, ts TIMESTAMP, repo STRING, diff_sha STRING") \
        .write.parquet(src)
    stream = spark.readStream.schema("request_id STRING, ts TIMESTAMP, repo STRING, diff_sha STRING") \
        .parquet(src)
    out, ck = scratch_path(spark, "t_req_out"), scratch_path(spark, "t_req_ck")
    q = (suppress_repeats_stream(stream).writeStream.format("parquet").option("checkpointLocation", ck)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    kept = sorted(r.request_id for r in spark.read.parquet(out).collect())
    # one of the two repeats survives (arrival order decides within a micro-batch)
    assert len(kept) == 2 and kept[1] == "r3" and kept[0] in ("r1", "r2")


def test_stream_restart_processes_only_new_files(spark):
    cs = doc_changesets(spark, SF001).cache()
    first = cs.filter(F.col("changeset_id") < "es")
    rest = cs.filter(F.col("changeset_id") >= "es")
    src = scratch_path(spark, "t_restart_src")
    first.write.parquet(src)
    out, ck = scratch_path(spark, "t_restart_out"), scratch_path(spark, "t_restart_ck")
    process_stream(spark, src, out, ck).awaitTermination()
    n1 = spark.read.parquet(out).count()
    rest.write.mode("append").parquet(src)
    process_stream(spark, src, out, ck).awaitTermination()   # same checkpoint: resumes
    streamed = sorted(tuple(r) for r in spark.read.parquet(out).select(*PROCESSED_COLUMNS).collect())
    batch = sorted(tuple(r) for r in processed_view(cs).collect())
    assert n1 == first.count() and streamed == batch


def test_suppression_goes_on_after_a_restart(spark):
    """Runs on one checkpoint: repeats of kept requests go, late ones go, and a kept
    request is forgotten once the watermark has passed it."""
    t0 = dt.datetime(2024, 1, 1)
    hour = dt.timedelta(hours=1)
    schema = "request_id STRING, repo STRING, diff_sha STRING, ts TIMESTAMP"
    src, out, ck = (scratch_path(spark, f"t_sup_{n}") for n in ("src", "out", "ck"))
    arrivals = [
        ([("a1", "r", "s", t0), ("b1", "r", "t", t0 + 5 * hour), ("u1", None, "s", t0)], {"a1", "b1", "u1"}),
        # watermark 3 h: a1 (expires 2 h) is forgotten, b1 (7 h) is not; l1 is late
        ([("a2", "r", "s", t0 + 6 * hour), ("b2", "r", "t", t0 + 6 * hour), ("l1", "x", "y", t0 + hour), ("u2", None, "s", t0 + 6 * hour)], {"a2", "u2"}),
        # watermark 4 h: a2 (8 h) and b1 (7 h) are remembered
        ([("a3", "r", "s", t0 + 20 * hour), ("b3", "r", "t", t0 + 20 * hour)], set()),
        # watermark 18 h: nothing is remembered
        ([("a4", "r", "s", t0 + 19 * hour), ("b4", "r", "t", t0 + 17 * hour)], {"a4"}),
    ]
    kept = set()
    for rows, new in arrivals:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        suppress_stream(spark, src, out, ck, delay="2 hours").awaitTermination()
        kept |= new
        assert {r.request_id for r in spark.read.schema(schema).parquet(out).collect()} == kept
