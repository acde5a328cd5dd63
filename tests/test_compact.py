"""Summary rendering (H1-H4), routing (H6) and size thresholds."""

from pyspark.sql import functions as F

import diffs as D
from hunkline.operators.compact import process_diffs, summary_col
from hunkline.operators.parse import parse_files
from hunkline.operators.stats import rollup_by, with_is_large, with_stats


def frame(spark, **named):
    return spark.createDataFrame([(k, k, v) for k, v in named.items()],
                                 "repo STRING, changeset_id STRING, diff STRING")


def summary(spark, diff, n=20):
    s = with_stats(parse_files(frame(spark, x=diff)))
    return s.select(summary_col(F.col("files"), F.col("total_files"), F.col("total_additions"),
                                F.col("total_deletions"), n)).first()[0]


def test_statistics_header_and_labels(spark):
    s = summary(spark, D.TWO_FILES)
    assert "## Diff Summary" in s and "2 files changed" in s
    assert "2 insertions(+)" in s and "1 deletion(-)" in s
    assert "**Status**: New file" in summary(spark, D.NEW_FILE)
    assert "**Status**: Deleted" in summary(spark, D.DELETED)
    assert "**Status**: Renamed from `docs/guide.md`" in summary(spark, D.RENAMED)
    assert "**Type**: Binary file" in summary(spark, D.BINARY)
    one = summary(spark, D.MODIFIED)
    assert "1 file changed" in one and "1 insertion(+)" in one and "1 deletion(-)" in one


def test_truncation(spark):
    # the new file has 5 additions, 3 of them non-blank after a JS trim
    s = summary(spark, D.NEW_FILE, 2)
    assert "... and 1 more changes" in s
    assert "... and" not in summary(spark, D.NEW_FILE, 100)


def test_exact_summary_text(spark):
    s = summary(spark, D.MODIFIED)
    assert s == ("## Diff Summary\n\n**Statistics**: 1 file changed, 1 insertion(+), 1 deletion(-)\n\n"
                 "### app/settings.py\n**Changes**: +1 -1\n\n**Key changes**:\n```\n"
                 "- PORT = 8000\n+ PORT = 8080\n```\n\n")


def test_undefined_old_path_quirk(spark):
    s = summary(spark, "diff --git a/s b/s\nrename from s\n")
    assert "**Status**: Renamed from `undefined`" in s


def test_routing(spark):
    out = {r.changeset_id: r for r in process_diffs(
        frame(spark, small=D.NEW_FILE, big=D.hundred_files(), two=D.TWO_FILES)).collect()}
    assert out["small"].was_compacted is False and out["small"].content == D.NEW_FILE
    assert out["small"].total_files == 1
    assert out["big"].was_compacted is True and "## Diff Summary" in out["big"].content
    assert out["big"].total_files == 100
    t = out["two"]
    assert (t.total_files, t.total_additions, t.total_deletions, t.total_changes) == (2, 2, 1, 3)


def _n_files(n, adds_each=1):
    return "".join(f"diff --git a/f{i} b/f{i}\n@@ -0,0 +1,{adds_each} @@\n" + "+x\n" * adds_each
                   for i in range(n))


def test_exact_boundaries(spark):
    cases = {"f50": _n_files(50), "f51": _n_files(51), "c500": _n_files(1, 500), "c501": _n_files(1, 501),
             "t37500": "a" * 37500, "t37501": "a" * 37501}
    got = {r.changeset_id: r.is_large for r in with_is_large(with_stats(
        parse_files(frame(spark, **cases), with_changes=False))).collect()}
    assert got == {"f50": False, "f51": True, "c500": False, "c501": True,
                   "t37500": False, "t37501": True}


def test_row_local_plan_has_no_exchange_or_python(spark):
    df = process_diffs(frame(spark, a=D.TWO_FILES), split_over_bytes=None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_one_scan_and_one_extraction_on_a_stored_table(spark, tmp_path):
    path = str(tmp_path / "cs")
    frame(spark, a=D.TWO_FILES, b=D.hundred_files()).write.parquet(path)
    stored = spark.read.parquet(path)
    for df in (process_diffs(stored), rollup_by(process_diffs(stored).withColumn("is_large", F.col("was_compacted")), ["repo"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and plan.count("regexp_extract(concat(") == 1


def test_content_equals_the_summary_of_parsed_files(spark):
    from test_parse import QUIRKS
    cases = {f"q{i}": d for i, d in enumerate(QUIRKS.values())}
    cases |= {"tokens": D.hundred_files() * 2 + "".join(QUIRKS.values()) + D.BINARY, "files": D.hundred_files(), "two": D.TWO_FILES}
    cs = frame(spark, **cases)
    s = with_stats(parse_files(cs))
    want = {r.changeset_id: r.x for r in s.select("changeset_id", summary_col(
        F.col("files"), F.col("total_files"), F.col("total_additions"), F.col("total_deletions"), 15).alias("x")).collect()}
    for tokens in (0, 15_000, 10**9):  # large by tokens, as routed, by the other thresholds only
        got = process_diffs(cs, max_tokens=tokens, max_changes=0).collect()
        for r in got:
            assert r.content == (want[r.changeset_id] if r.was_compacted else cases[r.changeset_id])
        assert any(r.was_compacted for r in got)


def test_file_by_file_route_agrees(spark):
    from test_parse import QUIRKS
    big = D.hundred_files() * 2 + "".join(QUIRKS.values()) + D.BINARY
    cases = {"big": big, "pre": "junk before\n" + big, "nofiles": "x" * 40000, "small": D.TWO_FILES}
    cs = frame(spark, **cases)
    a = sorted(tuple(r) for r in process_diffs(cs, split_over_bytes=None).collect())
    b = sorted(tuple(r) for r in process_diffs(cs, split_over_bytes=0).collect())
    assert a == b
    by_id = {r.changeset_id: r for r in process_diffs(cs, split_over_bytes=0).collect()}
    assert by_id["big"].was_compacted and by_id["big"].total_files == 209
    assert by_id["nofiles"].total_files == 0 and by_id["nofiles"].was_compacted


def test_routes_agree_on_equal_rows_and_null_ids(spark):
    big = D.hundred_files()
    rows = [("r", "a", big), ("r", "a", big), ("r", "a", big + D.TWO_FILES), (None, None, big), (None, None, big),
            ("r", "x", "x" * 40000), ("r", "x", "x" * 40000), ("r", "s", D.TWO_FILES), ("r", "n", None), ("r", "n", None)]
    df = spark.createDataFrame(rows, "repo STRING, changeset_id STRING, diff STRING")
    want = sorted(map(repr, process_diffs(df, split_over_bytes=None).collect()))
    assert len(want) == len(rows)
    for over in (0, 100, None):
        assert sorted(map(repr, process_diffs(df, split_over_bytes=over).collect())) == want


def test_null_diff_is_kept_as_empty(spark):
    df = spark.createDataFrame([("r", "n", None), ("r", "s", D.NEW_FILE)],
                               "repo STRING, changeset_id STRING, diff STRING")
    got = {r.changeset_id: r for r in process_diffs(df).collect()}
    assert set(got) == {"n", "s"}
    assert (got["n"].total_files, got["n"].was_compacted, got["n"].content) == (0, False, "")
