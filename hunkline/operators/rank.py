"""Skew-safe dense position within a group.

``row_number() over (partition by g order by k)`` puts each group in one
task; one hot group then becomes one straggler. Here each group is cut into
buckets of neighbouring keys: bounds come from a sample of the group (the keys with
the smallest hashes, at most ``SAMPLE`` of them, found by a limited ranking that
prunes in the reading tasks), and a row's bucket is the number of bounds below its
key. Rows are numbered in their (group, bucket), and a small ``(bucket, g) ->
count`` table gives every bucket its offset; it has at most ``#buckets`` rows per
group. All of it is one lazy plan, and each step depends on the rows alone, so a
task that runs again gets the same buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
SAMPLE = 960    # sampled keys of a group: 15 a bucket


def bucket_bounds(keyed: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """(group columns, ``_bounds``): at most ``buckets - 1`` keys, ascending, that cut
    a group into parts of about equal size."""
    sampled = Window.partitionBy(*group).orderBy(F.xxhash64("_ord"), "_ord")
    sample = (keyed.select(*group, "_ord").withColumn("_r", F.row_number().over(sampled)).filter(F.col("_r") <= SAMPLE)
              .groupBy(*group).agg(F.sort_array(F.collect_list("_ord")).alias("_s")))
    step = F.size("_s") / buckets
    return sample.select(*group, F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get(
        "_s", F.floor(i * step).cast("int"))).alias("_bounds")) if buckets > 1 else sample.select(*group, F.slice("_s", 1, 0).alias("_bounds"))


def position_within(df: DataFrame, group: list[str], order: list[Column], out: str = "pos",
                    buckets: int = BUCKETS) -> DataFrame:
    """Add ``out`` = 1-based position of each row in its group by ``order``.

    ``order`` must be a total order within the group (ties get an arbitrary
    but consistent position).
    """
    keyed = df.withColumn("_ord", F.struct(*order))
    bounds = bucket_bounds(keyed, group, buckets)
    bounds = bounds.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_bounds")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    r = keyed.join(bounds, same).withColumn("_b", F.size(F.filter("_bounds", lambda b: b < F.col("_ord"))))
    local = r.select(*df.columns, "_ord", "_b").withColumn(
        "_local", F.row_number().over(Window.partitionBy("_b", *group).orderBy("_ord")))
    counts = local.groupBy("_b", *group).agg(F.max("_local").alias("_n"))
    prior = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_b").alias("_ob"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                         F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"))
    return (local.join(offs, [F.col("_b") == F.col("_ob"), *same])
                 .select(*df.columns, (F.col("_off") + F.col("_local")).cast("int").alias(out)))
