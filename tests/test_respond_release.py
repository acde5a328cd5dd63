"""Response cleaning, error classes (G1-G6), catalogue (I1-I6, F4) and releases."""


from hunkline.operators.catalog import best_model, eligible_models, priority_table
from hunkline.operators.release import conformance, next_version, parse_subject
from hunkline.operators.respond import classify_errors, clean_responses

ERR = "request_id STRING, model STRING, error_message STRING, status INT, response_status INT, " \
      "response_error_message STRING, details STRING, language STRING"


def test_clean(spark):
    df = spark.createDataFrame([("  feat: x\n",), ('""hi"',), ('"',), ("'a'",)], "text STRING")
    got = [(r.message, r.has_message) for r in clean_responses(df).collect()]
    assert got == [("feat: x", True), ('"hi', True), ("", False), ("a", True)]


def test_error_precedence(spark):
    rows = [("a", "m", "INVALID_ARGUMENT: x", 400, None, None, None, "en"),
            ("b", "m", "quota exceeded", 0, 404, None, None, "en"),
            ("c", "m", "boom", 0, 404, None, None, "en"),
            ("d", "m", "INVALID_ARGUMENT: y", None, None, "", "more", "en"),
            ("e", "m", "", None, None, None, None, "en"),
            ("f", "m", "fetch failed", 500, None, None, None, "es"),
            ("g", "m", "odd", 500, None, "resp", None, "en"),
            ("h", "m", "PERMISSION_DENIED", 429, None, None, None, "es")]
    df = classify_errors(spark.createDataFrame(rows, ERR))
    got = {r.request_id: r for r in df.collect()}
    assert [got[k].error_class for k in "abcdefgh"] == [
        "invalid_key", "rate_limited", "model_not_found", "invalid_argument", "other", "connection",
        "other", "permission_denied"]
    assert got["c"].retry is True and got["a"].retry is False
    assert got["d"].user_text.endswith("more")
    assert "Message: Error\n" in got["e"].user_text and "Status" not in got["e"].user_text
    assert "Status: 500\nDetails: resp" in got["g"].user_text
    assert got["f"].user_text.startswith("Error de conexión")


def test_best_model(spark):
    cat = spark.createDataFrame([
        ("k1", "models/gemini-2.5-pro", None, None, ["generateContent"]),
        ("k1", "models/gemini-2.0-flash", "", None, ["generateContent"]),
        ("k1", "models/gemini-embedding-1", None, None, ["generateContent"]),
        ("k2", "models/gemma-x", "G", None, ["generateContent"]),
        ("k2", "models/gemini-a", None, None, ["generateContent"]),
        ("k3", "models/gemini-flash-latest", None, None, ["countTokens"]),
    ], "catalog_id STRING, name STRING, display_name STRING, description STRING, methods ARRAY<STRING>")
    el = eligible_models(cat)
    assert {r.name for r in el.collect()} == {"gemini-2.5-pro", "gemini-2.0-flash", "gemma-x", "gemini-a"}
    assert {r.display_name for r in el.filter("name = 'gemini-2.0-flash'").collect()} == \
        {"models/gemini-2.0-flash"}
    cats = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "catalog_id STRING")
    got = {r.catalog_id: (r.best_model, r.source)
           for r in best_model(el, cats, priority_table(spark)).collect()}
    assert got == {"k1": ("gemini-2.5-pro", "priority"), "k2": ("gemini-a", "first"),
                   "k3": ("gemini-flash-latest", "fallback")}


def test_next_version(spark):
    df = spark.createDataFrame([("1.2.3", "major", None), ("1.2.3", "minor", None), ("1.2.3", None, None),
                                ("1.2.3", "patch", "4.0.0"), ("x.y", "patch", None)],
                               "version STRING, bump STRING, explicit_version STRING")
    assert [r.next_version for r in next_version(df).collect()] == ["2.0.0", "1.3.0", "1.2.4", "4.0.0", None]


def test_subject_rules(spark):
    df = spark.createDataFrame([("feat(api): add retry\n\nbody",), ("Fix: Bad.",),
                                ("fix!: drop v1\n\n" + "x" * 73,), ("no type here",)], "message STRING")
    got = conformance(parse_subject(df)).collect()
    assert (got[0].commit_type, got[0].scope, got[0].conforms) == ("feat", "api", True)
    assert (got[1].type_ok, got[1].lowercase_ok, got[1].no_period_ok) == (False, False, False)
    assert (got[2].breaking, got[2].wrapped_ok) == (True, False)
    assert got[3].commit_type is None and got[3].conforms is False


def test_catalog_rejects_rows_without_name(spark):
    from hunkline.operators.catalog import rejects
    cat = spark.createDataFrame([("k", None, None, None, ["generateContent"]),
                                 ("k", "models/gemini-x", None, None, ["generateContent"])],
                                "catalog_id STRING, name STRING, display_name STRING, description STRING, "
                                "methods ARRAY<STRING>")
    assert [r.name for r in eligible_models(cat).collect()] == ["gemini-x"]
    assert rejects(cat).count() == 1


def _outcomes(spark, rows):
    return spark.createDataFrame(rows, "seq INT, request_id STRING, repo STRING, changeset_id STRING, outcome STRING, "
                                       "error_class STRING, model_used STRING, final_text STRING")


def test_message_sink_is_keyed_and_repeatable(spark):
    from hunkline.sources.message_sink import read_messages, write_messages
    from hunkline.streaming.incremental import scratch_path
    path = scratch_path(spark, "t_sink")
    assert read_messages(spark, path).collect() == []  # never written to
    write_messages(_outcomes(spark, []), path)
    assert read_messages(spark, path, None).collect() == []
    first = _outcomes(spark, [(1, "a", "r", "c1", "message", None, "m1", "fix: a"), (2, "b", "r", "c1", "message", None, "m1", "fix: b"),
                              (3, "c", "r", "c2", "error", "other", None, "boom"), (4, "d", "s", "c1", "message", None, "m1", ""),
                              (5, "e", None, "c9", "message", None, "m1", "lost"), (6, "f", None, "c9", "message", None, "m1", "lost"),
                              (7, "g", "s", None, "message", None, "m1", "lost")])
    second = _outcomes(spark, [(8, "h", "r", "c2", "message", None, "m2", "feat: h"), (9, "i", "t", "c1", "message", None, "m2", "docs: i")])

    def state(outcome=None):
        return sorted((r.repo or "", r.changeset_id or "", r.request_id, r.outcome, r.message) for r in read_messages(spark, path, outcome).collect())

    write_messages(first, path)
    one = state()
    assert one == [("", "c9", "e", "no_repository", None), ("", "c9", "f", "no_repository", None), ("r", "c1", "b", "message", "fix: b"),
                   ("r", "c2", "c", "rejected", None), ("s", "", "g", "no_repository", None), ("s", "c1", "d", "rejected", None)]
    write_messages(first, path)
    assert state() == one
    write_messages(second, path)
    write_messages(second, path)
    assert state("message") == [("r", "c1", "b", "message", "fix: b"), ("r", "c2", "h", "message", "feat: h"), ("t", "c1", "i", "message", "docs: i")]
    assert len(state()) == len(one) + 1


def test_model_responses_are_turned_down_whole(spark):
    from hunkline.operators.catalog import models_from_response, response_rejects
    model = '{"name": "models/gemini-x", "supportedGenerationMethods": ["generateContent"]}'
    bodies = {
        "good": (200, '{"models": [%s], "next": 1}' % model), "no status": (None, '{"models": [%s]}' % model),
        "none": (200, "{}"), "null list": (200, '{"models": null}'), "false": (200, '{"models": false}'), "zero": (200, '{"models": 0}'),
        "blank": (200, '{"models": ""}'), "empty": (200, '{"models": []}'), "array": (200, "[]"), "number": (200, "5"),
        "idle": (200, '{"models": [{"displayName": "x", "supportedGenerationMethods": ["embed"]}, {"name": "models/e"}]}'),
        "text list": (200, '{"models": "x"}'), "object list": (200, '{"models": {"name": "x"}}'), "broken": (200, '{"models": [%s' % model),
        "plain": (200, "not json"), "json null": (200, "null"), "blank body": (200, ""), "no body": (200, None),
        "nameless": (200, '{"models": [%s, {"supportedGenerationMethods": ["generateContent"]}]}' % model),
        "null model": (200, '{"models": [%s, null]}' % model), "failed": (503, '{"models": [%s]}' % model)}
    df = spark.createDataFrame([(k, s, b) for k, (s, b) in bodies.items()], "k STRING, status INT, body STRING")
    got = {(r.k, r.name) for r in models_from_response(df, "body", ["k"], "status").collect()}
    assert got == {("good", "models/gemini-x"), ("no status", "models/gemini-x"), ("idle", None), ("idle", "models/e")}
    bad = {r.k: r.reason for r in response_rejects(df, "body", ["k"], "status").collect()}
    assert bad == {**dict.fromkeys(("text list", "object list", "broken", "plain", "json null", "blank body", "no body"), "malformed"),
                   "nameless": "unnamed_model", "null model": "unnamed_model", "failed": "http_status"}


def test_model_responses_tolerate_missing_and_malformed(spark):
    from hunkline.operators.catalog import models_from_response
    df = spark.createDataFrame([("a", '{"models": [{"name": "models/gemini-x", "supportedGenerationMethods": '
                                      '["generateContent"]}]}'),
                                ("b", "{}"), ("c", "not json"), ("d", None)], "k STRING, body STRING")
    got = [(r.k, r.name, r.methods) for r in models_from_response(df, "body", ["k"]).collect()]
    assert got == [("a", "models/gemini-x", ["generateContent"])]


def test_version_chain_equals_one_release_after_another(spark):
    import random
    from hunkline.operators.release import version_chain
    rng = random.Random(3)
    rows = [(p, i, rng.choice(["major", "minor", "minor", "patch", "patch", "patch", "none", None, "odd"]))
            for p, n in (("hot", 150), ("b", 7), ("c", 1)) for i in rng.sample(range(10_000), n)]
    rows += [("quiet", i, "none") for i in range(5)] + [("patches", i, "patch") for i in range(9)]
    want = {}
    for p in {r[0] for r in rows}:
        v = [2, 3, 4]
        for _, i, b in sorted(r for r in rows if r[0] == p):
            v = {"major": [v[0] + 1, 0, 0], "minor": [v[0], v[1] + 1, 0], "patch": [v[0], v[1], v[2] + 1]}.get(b, v)
            want[p, i] = ".".join(map(str, v))
    df = spark.createDataFrame(rows, "package STRING, ordinal INT, bump STRING").repartition(3)
    for block in (1, 2, 5, 10_000):
        got = version_chain(df, start="2.3.4", block=block)
        assert got.columns == ["package", "ordinal", "bump", "version"]
        assert {(r.package, r.ordinal): r.version for r in got.collect()} == want
    assert version_chain(df.limit(0)).count() == 0


def test_retry_plan_carries_the_prompt(spark):
    from hunkline.operators.respond import retry_plan
    errors = spark.createDataFrame([("a", "m", "k", "c1", True), ("b", "m", "k", "c9", True), ("c", "m", "k", "c1", False), ("d", "m", "k", None, True)],
                                   "request_id STRING, model STRING, catalog_id STRING, changeset_id STRING, retry BOOLEAN")
    best = spark.createDataFrame([("k", "better")], "catalog_id STRING, best_model STRING")
    prompts = spark.createDataFrame([("c1", "say it"), ("c2", "no")], "changeset_id STRING, prompt STRING")
    got = sorted(tuple(r) for r in retry_plan(errors, best, prompts=prompts).select("request_id", "retry_model", "prompt").collect())
    assert got == [("a", "better", "say it"), ("b", "better", None), ("d", "better", None)]
    assert retry_plan(errors, best).columns == ["request_id", "failed_model", "retry_model"]
