"""Parser (B1-B11), line numbers, quirks Q1-Q8, and row-local == exploded."""

import pytest
from pyspark.sql import functions as F

import diffs as D
from hunkline.operators.lines import all_section_lines, hunks, numbered_lines
from hunkline.operators.parse import parse_files
from hunkline.operators.stats import with_stats


def frame(spark, **named):
    return spark.createDataFrame([(k, k, v) for k, v in named.items()],
                                 "repo STRING, changeset_id STRING, diff STRING")


def files_of(spark, diff):
    df = parse_files(frame(spark, x=diff))
    return [r.asDict(recursive=True) for r in df.select(F.inline("files")).collect()]


@pytest.mark.parametrize("name,n,path,adds,dels,flags", [
    ("new", 1, "lib/math.py", 5, 0, {"is_new": True, "is_deleted": False, "is_renamed": False, "is_binary": False}),
    ("modified", 1, "app/settings.py", 1, 1, {"is_new": False, "is_deleted": False}),
    ("deleted", 1, "legacy/util.py", 0, 3, {"is_deleted": True}),
    ("renamed", 1, "docs/user/guide.md", 1, 0, {"is_renamed": True}),
    ("binary", 1, "assets/logo.png", 0, 0, {"is_binary": True, "is_new": True}),
    ("two_hunks", 1, "server.js", 5, 0, {}),
])
def test_single_file_shapes(spark, name, n, path, adds, dels, flags):
    fs = files_of(spark, D.ALL[name])
    assert len(fs) == n
    f = fs[0]
    assert (f["path"], f["additions"], f["deletions"]) == (path, adds, dels)
    for k, v in flags.items():
        assert f[k] is v
    if name == "new":
        assert [c["change_type"] for c in f["changes"]] == ["addition"] * 5
    if name == "renamed":
        assert f["old_path"] == "docs/guide.md"
    if name == "binary":
        assert f["changes"] == []


def test_two_files_in_order(spark):
    fs = files_of(spark, D.TWO_FILES)
    assert [f["path"] for f in fs] == ["src/x.js", "src/y.js"]
    assert [(f["additions"], f["deletions"]) for f in fs] == [(1, 0), (1, 1)]
    assert [f["file_no"] for f in fs] == [1, 2]


def test_empty_diff_has_zero_stats(spark):
    s = with_stats(parse_files(frame(spark, e=""))).first()
    assert (s.total_files, s.total_additions, s.total_deletions, s.total_changes) == (0, 0, 0, 0)


def test_concatenated_diffs_sum(spark):
    s = with_stats(parse_files(frame(spark, c=D.NEW_FILE + D.DELETED + D.TWO_FILES))).first()
    assert (s.total_files, s.total_additions, s.total_deletions) == (4, 7, 4)
    assert s.total_changes == 11


QUIRKS = {
    # Q1: '+++x' and '---x' inside a hunk are not changes
    "q1": "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1,2 @@\n+++x\n---y\n+ok\n-gone\n",
    # Q3: GIT binary patch is not "binary" and has no hunk
    "q3": "diff --git a/b.bin b/b.bin\nGIT binary patch\nliteral 3\nabc\n",
    # Q4: a copy looks renamed because paths differ
    "q4": "diff --git a/a.txt b/c.txt\nsimilarity index 100%\ncopy from a.txt\ncopy to c.txt\n",
    # Q5: quoted paths / no prefix: header does not match, file dropped
    "q5": 'diff --git "a/sp ace" "b/sp ace"\nindex 1..2\ndiff --git x.txt x.txt\n@@ -1 +1 @@\n+a\n',
    # Q6: CRLF header: dropped
    "q6": "diff --git a/w.txt b/w.txt\r\n@@ -1 +1 @@\r\n+a\r\n",
    # Q7: rename marker with equal paths: renamed, no old path
    "q7": "diff --git a/same.txt b/same.txt\nrename from same.txt\nrename to same.txt\n",
    # Q8: binary section with a hunk: no changes
    "q8": "diff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n@@ -1 +1 @@\n+x\n",
    # header path containing ' b/': lazy old path, the rest is the new path
    "bpath": "diff --git a/x b/y b/x b/y\n@@ -1 +1 @@\n+z\n",
    # text before the first marker is a section without a header -> dropped;
    # a marker in mid-line does not split; a marker after U+2028 does
    "split": "preamble\ndiff --git a/m.txt b/m.txt\n@@ -1 +1 @@\n+x diff --git a/no b/no\n diff --git a/u.txt b/u.txt\n",
    # a combined diff (--cc) is not split and its header does not match
    "cc": "diff --cc merged.txt\nindex 1,2..3\n@@@ -1,1 -1,1 +1,1 @@@\n++x\n",
}


def test_quirks(spark):
    q = {k: files_of(spark, v) for k, v in QUIRKS.items()}
    assert [(f["additions"], f["deletions"]) for f in q["q1"]] == [(1, 1)]
    assert (q["q3"][0]["is_binary"], q["q3"][0]["additions"]) == (False, 0)
    assert (q["q4"][0]["is_renamed"], q["q4"][0]["old_path"], q["q4"][0]["path"]) == (True, "a.txt", "c.txt")
    assert q["q5"] == [] and q["q6"] == [] and q["cc"] == []
    assert (q["q7"][0]["is_renamed"], q["q7"][0]["old_path"]) == (True, None)
    assert (q["q8"][0]["is_binary"], q["q8"][0]["changes"], q["q8"][0]["additions"]) == (True, [], 0)
    assert (q["bpath"][0]["old_path"], q["bpath"][0]["path"]) == ("x", "y b/x b/y")
    sp = q["split"]
    assert [f["path"] for f in sp] == ["m.txt", "u.txt"]
    assert [f["file_pos"] for f in sp] == [1, 2]
    assert sp[0]["changes"][0]["line"] == "x diff --git a/no b/no"


def test_line_numbers_follow_the_reference_counter(spark):
    cs = frame(spark, h=D.TWO_HUNKS, q=QUIRKS["q1"],
               bad="diff --git a/k b/k\n@@ -1 +7 @@\n a\n@@ broken @@\n+b\n@@ -1 +40 @@\n+c\n")
    rows = {(r.changeset_id, r.line_pos): r for r in numbered_lines(cs).collect()}
    # hunk 1 starts at 1; the raw blank line is ignored, so 'const port' gets 3 (Q2)
    assert [rows[("h", p)].line_number for p in (5, 6, 7, 8)] == [1, 2, None, 3]
    assert [rows[("h", p)].line_number for p in (10, 11, 12)] == [21, 22, 23]
    # Q1: '+++x'/'---y' get no number and do not advance the counter
    assert [rows[("q", p)].line_number for p in (4, 5, 6, 7)] == [None, None, 1, None]
    # an unparsable hunk header keeps the counter running; the next one resets it
    assert [rows[("bad", p)].line_number for p in (2, 4, 6)] == [7, 8, 40]
    assert rows[("bad", 4)].hunk_no == 2


def test_row_local_equals_exploded(spark):
    cs = frame(spark, **{k: v for k, v in D.ALL.items()}, **QUIRKS, big=D.hundred_files())
    a = {(r.changeset_id, r.file_no): (r.additions, r.deletions)
         for r in parse_files(cs).select("changeset_id", F.inline("files")).collect()}
    nl = numbered_lines(cs)
    b = {}
    for r in (nl.groupBy("changeset_id", "file_no")
                .agg(F.count_if(F.col("change_type") == "addition").alias("a"),
                     F.count_if(F.col("change_type") == "deletion").alias("d")).collect()):
        b[(r.changeset_id, r.file_no)] = (r.a, r.d)
    assert a == b
    assert hunks(nl).filter("changeset_id = 'two_hunks'").count() == 2


def test_section_lines_keep_trailing_empty(spark):
    rows = all_section_lines(frame(spark, m=D.MODIFIED)).orderBy("line_pos").collect()
    assert rows[0].line == "a/app/settings.py b/app/settings.py"
    assert rows[-1].line == ""


def test_split_line_starts_follow_javascript(spark):
    from hunkline.operators.parse import sections
    cases = ["\U0001F600diff --git a/x b/x\n", "\u0085diff --git a/n b/n\n",
             "\u2029diff --git a/w b/w\n", "\rdiff --git a/v b/v\n"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, d STRING")
    got = {r.i: r.s for r in df.select("i", sections(F.col("d")).alias("s")).collect()}
    # no split after an astral character or after U+0085 (Java's (?m)^ would split there)
    assert got[0] == [cases[0]] and got[1] == [cases[1]]
    assert got[2] == ["\u2029", "a/w b/w\n"] and got[3] == ["\r", "a/v b/v\n"]


@pytest.mark.parametrize("k", [1, 2, 3, 5, 64])
def test_blocked_line_numbers_equal_window(spark, k):
    cs = frame(spark, **{n: d for n, d in D.ALL.items()}, **QUIRKS, big=D.hundred_files(),
               bad="diff --git a/k b/k\n@@ -1 +7 @@\n a\n@@ broken @@\n+b\n x\n+y\n@@ -1 +40 @@\n+c\n",
               pre="diff --git a/p b/p\n+before\n c\n@@ -1 +3 @@\n+a\n c\n")
    a = sorted(tuple(r) for r in numbered_lines(cs).collect())
    b = sorted(tuple(r) for r in numbered_lines(cs, block_lines=k).collect())
    assert a == b
