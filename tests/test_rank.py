"""Skew-safe position within a group: a hot group is numbered by many tasks."""

from pyspark.sql import functions as F

from hunkline.operators.rank import bucket_bounds, position_within


def test_hot_group_dense_positions(spark):
    rows = [("hot", f"m-{i:05d}") for i in range(6000)] + [(f"g{j}", f"n-{i}") for j in range(9) for i in range(7)]
    df = spark.createDataFrame(rows, "catalog_id STRING, name STRING")
    out = position_within(df, ["catalog_id"], [F.collate("name", "UNICODE")], buckets=8)
    got = {}
    for r in out.collect():
        got.setdefault(r.catalog_id, []).append((r.pos, r.name))
    for cat, pairs in got.items():
        pairs.sort()
        assert [p for p, _ in pairs] == list(range(1, len(pairs) + 1))
        assert [n for _, n in pairs] == sorted(n for _, n in pairs)
    assert len(got["hot"]) == 6000


def test_hot_group_spans_buckets(spark):
    rows = [("hot", f"m-{i:05d}") for i in range(4000)] + [("cold", "x")]
    df = spark.createDataFrame(rows, "catalog_id STRING, name STRING").withColumn("_ord", F.struct("name"))
    bounds = {r.catalog_id: [b.name for b in r._bounds if b] for r in bucket_bounds(df, ["catalog_id"], 8).collect()}
    assert bounds["hot"] == sorted(bounds["hot"]) and len(set(bounds["hot"])) == 7
    sizes = [sum(1 for _, n in rows[:-1] if lo < n <= hi) for lo, hi in zip(["", *bounds["hot"]], [*bounds["hot"], "~"])]
    assert max(sizes) < 2 * 4000 / 8


def test_nothing_runs_before_an_action(spark):
    rows = [("a", i) for i in range(50)] + [(None, i) for i in range(7)] + [("tie", 1)] * 3
    df = spark.createDataFrame(rows, "g STRING, k INT").repartition(3)
    sc = spark.sparkContext
    sc.setJobGroup("rank-build", "")
    out = position_within(df, ["g"], [F.col("k")], buckets=5)
    assert sc.statusTracker().getJobIdsForGroup("rank-build") == []
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append((r.pos, r.k))
    assert sorted(got["a"]) == [(i + 1, i) for i in range(50)] and sorted(got[None]) == [(i + 1, i) for i in range(7)]
    assert sorted(got["tie"]) == [(1, 1), (2, 1), (3, 1)]
