"""Repository matching (D1-D3) on inline cases mirroring the reference suite."""

from hunkline.operators.repos import (changeset_disposition, default_repository, match_repository,
                                      repo_candidates)

REPOS = [("w0", 0, "/a"), ("w1", 0, "/only"), ("w2", 0, "/repo-a"), ("w2", 1, "/repo-b"),
         ("w3", 0, "/a"), ("w3", 1, "/b"), ("w3", 2, "/c"), ("w3", 3, "/d"),
         ("w4", 0, "file:///workspace/repo"), ("w4", 1, "/other"),
         ("w5", 0, "/dup"), ("w5", 1, "/dup")]
REQUESTS = [
    (1, "empty", "/repo-a"), (2, "empty", None),
    (3, "w1", None), (4, "w1", "/only"), (5, "w1", "/elsewhere"),
    (6, "w2", "/repo-a"), (7, "w2", "/repo-b"), (8, "w3", "/c"),
    (9, "w2", None), (10, "w2", "/repo-c"),
    (11, "w4", "file:///workspace/repo/"), (12, "w4", "file:///workspace/repo"),
    (13, "w5", "/dup"),
]


def test_match_repository(spark):
    repos = spark.createDataFrame(REPOS, "workspace STRING, repo_pos INT, root_uri STRING")
    req = spark.createDataFrame(REQUESTS, "request_id INT, workspace STRING, requested_uri STRING")
    m = {r.request_id: r for r in match_repository(req, repos).collect()}
    assert m[1].outcome == "none" and m[2].outcome == "none" and m[1].n_repos == 0
    assert [m[i].outcome for i in (3, 4, 5)] == ["single_fallback", "matched", "single_fallback"]
    assert [m[i].matched_uri for i in (3, 4, 5)] == ["/only"] * 3
    assert (m[6].matched_uri, m[7].matched_uri, m[8].matched_uri) == ("/repo-a", "/repo-b", "/c")
    assert (m[7].matched_pos, m[8].matched_pos) == (1, 2)
    assert m[9].outcome == "ambiguous" and m[10].outcome == "ambiguous"
    assert m[11].outcome == "ambiguous" and m[12].outcome == "matched"
    assert (m[13].outcome, m[13].matched_pos) == ("matched", 0)
    cand = repo_candidates(match_repository(req, repos), repos).collect()
    assert sorted({r.workspace for r in cand}) == ["w2", "w4"]
    assert {r.label for r in cand if r.workspace == "w4"} == {"repo", "other"}
    ws = spark.createDataFrame([("w2",), ("nothing",)], "workspace STRING")
    d = {r.workspace: r.root_uri for r in default_repository(ws, repos).collect()}
    assert d == {"w2": "/repo-a", "nothing": None}


def test_disposition(spark):
    df = spark.createDataFrame([(2, 0, False, "d"), (0, 0, True, "d"), (0, 3, True, "d"),
                                (0, 3, False, "d"), (1, 0, False, "")],
                               "n_index_changes INT, n_working_changes INT, auto_stage BOOLEAN, diff STRING")
    got = [r.disposition for r in changeset_disposition(df).collect()]
    assert got == ["staged", "nothing_to_do", "auto_stage", "needs_confirmation", "empty_diff"]
