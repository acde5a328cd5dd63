"""The strategies of a lookup give the same rows."""

from hunkline.operators.lookup import lookup


def test_broadcast_and_salted_lookups_agree(spark):
    big = spark.createDataFrame([(i, None if i % 7 == 0 else f"k{i % 3}", "x") for i in range(200)] * 2, "id INT, k STRING, v STRING")
    small = spark.createDataFrame([("k0", "a"), ("k1", None)], "k STRING, m STRING")
    a, b = lookup(big, small, "k"), lookup(big, small, "k", broadcast_rows=1)
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


def test_composite_and_null_safe_keys(spark):
    big = spark.createDataFrame([(i, None if i % 3 == 0 else "k", i % 2) for i in range(50)], "id INT, k STRING, j INT")
    small = spark.createDataFrame([("k", 0, "a"), (None, 1, "b"), ("k", None, "c")], "k STRING, j INT, m STRING")
    for null_safe in (False, True):
        want = sorted((r.id, r.k, r.j, "a" if (r.k, r.j) == ("k", 0) else "b" if null_safe and (r.k, r.j) == (None, 1) else None)
                      for r in big.collect())
        for rows in (10, 1):
            got = lookup(big, small, ["k", "j"], broadcast_rows=rows, null_safe=null_safe)
            assert got.columns == ["id", "k", "j", "m"]
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_big_side_is_not_shuffled_within_the_bound(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.range(1000).selectExpr("id", "id % 7 AS k").write.parquet(path)
    small = spark.range(7).selectExpr("id AS k", "id * 2 AS m")
    plan = lookup(spark.read.parquet(path), small, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
