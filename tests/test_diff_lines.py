"""Line-by-line diff-file scan equals the whole-text parser, with tiny splits."""

import os

import diffs as D
from test_parse import QUIRKS
from hunkline.operators.parse import parse_files
from hunkline.operators.stats import with_stats
from hunkline.functions import utf16_length
from hunkline.sources.diff_files import list_diff_files, scan_diff_files, write_diff_files
from pyspark.sql import functions as F

from hunkline.sources.diff_lines import diff_file_stats, diff_line_pieces
from hunkline.streaming.incremental import scratch_path


def test_line_scan_matches_whole_text(spark):
    named = {**D.ALL, **QUIRKS, "empty": "", "newline": "\n", "odd id/~%+ é": D.TWO_FILES, "open": D.TWO_FILES.rstrip("\n"),
             "marked": "\ufeff" + D.TWO_FILES, "wide": D.NEW_FILE + "+\U0001F600 tail", "open blank": "diff --git a/x b/x\n@@ -1 +1 @@\n+", "big": D.hundred_files(),
             "pre": "junk\na/p b/q\n" + D.TWO_FILES, "crmark": "x\rdiff --git a/c b/c\n@@ -1 +1 @@\n+y\n",
             "hunks_late": "diff --git a/h b/h\n+no\n-no\n" + "ctx\n" * 30 + "@@ -1 +1 @@\n+yes\n-yes\n"}
    cs = spark.createDataFrame([(k, k, v) for k, v in named.items()],
                               "repo STRING, changeset_id STRING, diff STRING")
    path = scratch_path(spark, "t_lines")
    write_diff_files(cs, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        got = {r.changeset_id: (r.total_files, r.total_additions, r.total_deletions, r.diff_units)
               for r in diff_file_stats(spark, path).collect()}
        blocks = (diff_line_pieces(spark, path).groupBy("file").agg(F.countDistinct("blk").alias("n"))
                  .agg(F.max("n")).first()[0])
        assert blocks > 10  # files really are read as many splits
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.changeset_id: r.diff for r in scan_diff_files(spark, path).collect()} == named
    want = {r.changeset_id: (r.total_files, r.total_additions, r.total_deletions, r.u)
            for r in with_stats(parse_files(cs, with_changes=False)).withColumn("u", utf16_length("diff")).collect()}
    assert got == want
    assert want["empty"] == (0, 0, 0, 0)


def test_ten_thousand_files_without_a_folder_each(spark):
    path = scratch_path(spark, "t_many")
    cs = spark.range(10_000).select(F.col("id").cast("string").alias("changeset_id"), F.when(F.col("id") % 10 > 0, F.concat(
        F.lit("diff --git a/x b/x\n@@ -1 +1 @@"), F.repeat(F.lit("\n+y"), (F.col("id") % 5).cast("int")))).alias("diff"))
    write_diff_files(cs, path)
    folders = sum(len(d) for _, d, _ in os.walk(path.removeprefix("file:")))
    assert folders <= 256
    whole = with_stats(parse_files(scan_diff_files(spark, path), with_changes=False))
    for got in (whole, diff_file_stats(spark, path)):
        r = got.agg(F.count("*").alias("n"), F.count_if(F.col("total_files") == 0).alias("empty"), F.sum("total_additions").alias("a")).first()
        assert (r.n, r.empty, r.a) == (10_000, 1_000, sum(i % 5 for i in range(10_000) if i % 10))
    write_diff_files(cs, path)  # again: the same files
    assert list_diff_files(spark, path).count() == 10_000


def test_empty_folder(spark, tmp_path):
    assert scan_diff_files(spark, str(tmp_path)).count() == 0
    assert diff_file_stats(spark, str(tmp_path)).count() == 0
