"""Message sink (A4): the message box of each change-set.

The sink is a Parquet table keyed by (repo, changeset_id): a box holds what was written
to it last. Rows are dealt to buckets by a hash of the key; an upsert rewrites only
the buckets it touches (dynamic partition overwrite), so writing the same outcomes
twice, or again after a failure, leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.schema import SINK
from hunkline.session import checkpoint_dir

MESSAGE, REJECTED, NO_REPOSITORY = "message", "rejected", "no_repository"
BUCKETS = 32
_KEY = ["repo", "changeset_id", "slot"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sink_outcome() -> Column:
    """What becomes of an answer: there may be no repository to write to, or
    nothing to write (a failure, or an empty message)."""
    known = F.col("repo").isNotNull() & F.col("changeset_id").isNotNull()
    text = F.length(F.coalesce(F.col("final_text"), F.lit(""))) > 0
    return (F.when(~known, F.lit(NO_REPOSITORY)).when((F.col("outcome") == "message") & text, F.lit(MESSAGE)).otherwise(F.lit(REJECTED)))


def sink_rows(outcomes: DataFrame, order: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """The sink's rows of ``outcomes`` (repo, changeset_id, request_id, outcome, error_class,
    model_used, final_text, and the order of writing): the last of each key, by a partial
    aggregation, so a box that a third of all answers go to is one row a task. An
    answer without a repository has a slot of its own."""
    slot = F.when(F.col("repo").isNull() | F.col("changeset_id").isNull(), F.col("request_id").cast("string"))
    result = sink_outcome()
    row = F.struct("request_id", result.alias("outcome"), "error_class", "model_used",
                   F.when(result == MESSAGE, F.col("final_text")).alias("message"))
    last = outcomes.groupBy("repo", "changeset_id", slot.alias("slot")).agg(F.max_by(row, F.struct(order, "request_id")).alias("r"))
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int")
    return last.select(*_KEY, "r.*").withColumn("bucket", bucket).select([F.col(f.name).cast(f.dataType) for f in SINK])


def write_messages(outcomes: DataFrame, path: str, order: str = "seq", buckets: int = BUCKETS) -> None:
    """A4: upsert. Rows of the sink with a written key are replaced, others stay."""
    spark = outcomes.sparkSession
    checkpoint_dir(spark)
    new = sink_rows(outcomes, order, buckets).checkpoint(eager=True)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    old = _read(spark, path).filter(F.col("bucket").isin(touched))
    keys = new.select(*[F.col(k).alias(f"new_{k}") for k in _KEY])
    same = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in _KEY]
    rows = old.join(keys, same, "left_anti").unionByName(new)
    (rows.repartition(buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def _read(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], SINK)
    return spark.read.schema(SINK).parquet(path)


def read_messages(spark: SparkSession, path: str, outcome: str | None = MESSAGE) -> DataFrame:
    """The sink's rows of one outcome (None: all). A sink that was never written to is empty."""
    rows = _read(spark, path).drop("slot", "bucket")
    return rows if outcome is None else rows.filter(F.col("outcome") == outcome)
