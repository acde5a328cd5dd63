"""What must not be shuffled, sorted or windowed, on stored tables."""

import pytest
from pyspark.sql import functions as F

import diffs as D
from hunkline.operators.catalog import best_model, mark_current, priority_table
from hunkline.operators.compact import process_diffs
from hunkline.operators.lines import change_lines, file_hunks, hunks, numbered_lines
from hunkline.operators.lookup import lookup
from hunkline.operators.parse import parse_files, parse_files_col
from hunkline.operators.prompt import prompt_col, resolve_settings
from hunkline.operators.repos import match_repository


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    def write(rows, schema):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)
    return write


def test_requests_stay_in_place(stored):
    requests = stored([(1, "w", "/a"), (2, "w", None), (3, None, "/a")], "request_id INT, workspace STRING, requested_uri STRING")
    repos = stored([("w", 0, "/a"), ("w", 1, "/b")], "workspace STRING, repo_pos INT, root_uri STRING")
    m = match_repository(requests, repos)
    assert "Exchange hashpartitioning" not in plan(m) and "SortMergeJoin" not in plan(m)
    assert {r.request_id: r.outcome for r in m.collect()} == {1: "matched", 2: "ambiguous", 3: "none"}


def test_models_stay_in_place(spark, stored):
    models = stored([("k", "a"), ("k", "b")], "catalog_id STRING, name STRING")
    current = stored([("k", "b")], "catalog_id STRING, current_model STRING")
    assert "Exchange hashpartitioning" not in plan(mark_current(models, current))
    best = best_model(models, current.select("catalog_id"), priority_table(spark))
    partial = plan(best).split("BroadcastHashJoin [name")[-1]
    assert "SortMergeJoin [name" not in plan(best) and "Exchange hashpartitioning" not in partial


def test_content_stays_in_place(stored):
    cs = stored([("r", "a", D.TWO_FILES)], "repo STRING, changeset_id STRING, diff STRING")
    settings = stored([("r", "es", None, None)], "repo STRING, language STRING, model STRING, token_limit BIGINT")
    routed = lookup(process_diffs(cs), resolve_settings(cs.select("repo").distinct(), settings), "repo")
    out = routed.withColumn("prompt", prompt_col("content", "language", "was_compacted", "total_files", "total_changes"))
    assert "Exchange hashpartitioning" not in plan(out)
    assert out.first().language == "es"


def _quirks(spark):
    from test_parse import QUIRKS
    named = {**D.ALL, **QUIRKS, "late": "diff --git a/h b/h\n+no\n@@ odd @@\n+a\n-b\n c\n@@ -1 +7,2 @@\n x\n+y\n-z\n@@@ odd\n+w\n@@ -1 +1 @@ f\n+q",
             "bin": D.BINARY + "@@ -1 +1 @@\n+x\n", "open": "diff --git a/h b/h\n@@ -1 +1 @@"}
    return spark.createDataFrame([(k, k, v) for k, v in named.items()], "repo STRING, changeset_id STRING, diff STRING")


def test_changes_and_hunks_need_no_window(spark):
    cs = _quirks(spark)
    lines = numbered_lines(cs)
    assert "Window" not in plan(change_lines(cs)) and "Exchange" not in plan(change_lines(cs))
    assert "Window" not in plan(file_hunks(cs)) and "Exchange" not in plan(file_hunks(cs))
    a = sorted(map(tuple, change_lines(cs).collect()))
    assert a == sorted(map(tuple, lines.filter("change_type IS NOT NULL").select(
        "changeset_id", "file_no", "line_pos", "change_type", F.col("text").alias("line")).collect())) and a
    h = hunks(lines)
    assert sorted(map(repr, file_hunks(cs).select(h.columns).collect())) == sorted(map(repr, h.collect()))


def test_nested_changes_carry_line_numbers(spark):
    cs = _quirks(spark)
    nested = parse_files(cs).select("changeset_id", F.inline("files")).select("changeset_id", "file_no", F.posexplode("changes"))
    got = [(r.changeset_id, r.file_no, r.col.change_type, r.col.line, r.col.line_number) for r in nested.orderBy("changeset_id", "file_no", "pos").collect()]
    flat = numbered_lines(cs).filter("change_type IS NOT NULL").orderBy("changeset_id", "file_no", "line_pos").collect()
    assert got == [(r.changeset_id, r.file_no, r.change_type, r.text, r.line_number) for r in flat]
    assert "Window" not in plan(parse_files(cs))
    plain = cs.select(parse_files_col("diff", True)[0]["changes"].alias("c")).schema["c"].dataType.elementType
    assert plain.fieldNames() == ["change_type", "line"]
