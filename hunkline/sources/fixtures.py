"""Change-set corpora derived from the driver tables.

Each builder returns ``changesets(repo, changeset_id, diff)`` (plus helper
columns) computed by Spark from base rows, so the work grows with the input.
Every builder bounds the size of one change-set by construction (a block of
keys), so no single group, task or diff string grows with the table.

The DuckDB oracle (``hunkline.plans.oracle``) computes expected answers from
the same base rows *without* parsing the diff text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.sources.tables import table

# documents per change-set block: a change-set is (lang, source, doc_id div DOC_BLOCK)
DOC_BLOCK = 1000
# orders per change-set block for the by-part corpus
ORDER_BLOCK = 1 << 16

# Header lines of our generated diffs.
INDEX_LINE = "index 0000000..1111111\n"
NEW_MODE = "new file mode 100644\n"
DELETED_MODE = "deleted file mode 100644\n"


def _kind(doc_id: Column) -> Column:
    m = doc_id % 4
    return (F.when(m == 0, F.lit("new")).when(m == 1, F.lit("deleted"))
             .when(m == 2, F.lit("renamed")).otherwise(F.lit("modified")))


def _prefixed_body(text: Column, kind: Column) -> Column:
    """Text lines with a diff marker each, newline-terminated.

    Single-marker kinds are one literal ``replace`` of each newline by
    newline + marker; only the cycling (modified) kind needs a per-line lambda."""
    cycle = F.array(F.lit(" "), F.lit("+"), F.lit("-"))
    single = (F.when(kind == "new", F.lit("+")).when(kind == "deleted", F.lit("-"))
               .when(kind == "renamed", F.lit(" ")))
    marked_single = F.concat(single, F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), single)))
    cycled = F.array_join(F.transform(F.split(text, "\n", -1),
                                      lambda l, i: F.concat(F.element_at(cycle, (i % 3) + 1), l)), "\n")
    return F.concat(F.when(single.isNotNull(), marked_single).otherwise(cycled), F.lit("\n"))


def file_section(path: Column, old: Column, kind: Column, is_binary: Column, text: Column,
                 new_start: Column, body: Column | None = None, n_lines: Column | None = None) -> Column:
    """One ``diff --git`` section for a file of the given kind.

    ``body``/``n_lines`` may be given directly (already marked lines) instead
    of being derived from ``text``."""
    n = (n_lines if n_lines is not None else F.size(F.split(text, "\n", -1))).cast("string")
    mode = (F.when(kind == "new", F.lit(NEW_MODE)).when(kind == "deleted", F.lit(DELETED_MODE))
             .when(kind == "renamed", F.concat(F.lit("similarity index 90%\nrename from "), old,
                                               F.lit("\nrename to "), path, F.lit("\n")))
             .otherwise(F.lit("")))
    binary = F.concat(F.lit("Binary files a/"), old, F.lit(" and b/"), path, F.lit(" differ\n"))
    minus = F.when(kind == "new", F.lit("/dev/null")).otherwise(F.concat(F.lit("a/"), old))
    plus = F.when(kind == "deleted", F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), path))
    old_range = F.when(kind == "new", F.lit("0,0")).otherwise(F.concat(F.lit("1,"), n))
    new_range = F.when(kind == "deleted", F.lit("0,0")).otherwise(
        F.concat(new_start.cast("string"), F.lit(","), n))
    textual = F.concat(F.lit("--- "), minus, F.lit("\n+++ "), plus, F.lit("\n@@ -"), old_range,
                       F.lit(" +"), new_range, F.lit(" @@\n"),
                       body if body is not None else _prefixed_body(text, kind))
    return F.concat(F.lit("diff --git a/"), old, F.lit(" b/"), path, F.lit("\n"), mode,
                    F.lit(INDEX_LINE), F.when(is_binary, binary).otherwise(textual))


def doc_files(documents: DataFrame, by_source_only: bool = False) -> DataFrame:
    """F_DOCS files: one file per document with its section text."""
    d = documents.select("doc_id", "text", "lang", "source")
    repo = F.col("source") if by_source_only else F.concat(F.col("lang"), F.lit("/"), F.col("source"))
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    kind = _kind(F.col("doc_id"))
    return (d.withColumn("repo", repo)
             .withColumn("changeset_id", F.concat(F.col("repo"), F.lit("#"),
                                                  F.floor(F.col("doc_id") / DOC_BLOCK).cast("string")))
             .withColumn("path", path)
             .withColumn("kind", kind)
             .withColumn("old_path", F.when(F.col("kind") == "renamed", F.concat(F.lit("old/"), F.col("path")))
                         .otherwise(F.col("path")))
             .withColumn("is_binary", F.col("doc_id") % 17 == 0)
             .withColumn("section", file_section(F.col("path"), F.col("old_path"), F.col("kind"),
                                                 F.col("is_binary"), F.col("text"),
                                                 F.when(F.col("kind") == "new", F.lit(1))
                                                  .otherwise(F.col("doc_id") % 5 + 1))))


def assemble(files: DataFrame, order_col: str, repo_of=None) -> DataFrame:
    """Concatenate file sections into one diff per change-set, in ``order_col`` order.

    One hash shuffle on ``changeset_id``; ``repo`` is derived from the id
    afterwards (``repo_of``), so the aggregate stays hash-based. The output
    stays hash-partitioned by ``changeset_id`` and later per-file windows reuse
    it without a second Exchange. Every group is bounded by the builder's
    block size.
    """
    out = (files.groupBy("changeset_id")
                 .agg(F.array_join(F.transform(
                     F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("k"),
                                                          F.col("section").alias("s")))),
                     lambda x: x["s"]), "").alias("diff")))
    repo = repo_of(F.col("changeset_id")) if repo_of else F.lit(None).cast("string")
    return out.select("changeset_id", repo.alias("repo"), "diff")


def doc_repo_of(changeset_id: Column) -> Column:
    """A documents change-set id is ``<repo>#<block>``."""
    return F.substring_index(changeset_id, "#", 1)


def doc_changesets(spark: SparkSession, sf_dir: str, by_source_only: bool = False) -> DataFrame:
    """F_DOCS: change-set = (lang/source, doc block); one file per document."""
    return assemble(doc_files(table(spark, sf_dir, "documents"), by_source_only), "doc_id", doc_repo_of)


def order_changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_ORDERS: change-set = order; one file per (order, line number).

    Duplicate (orderkey, linenumber) pairs are summed first, with map-side
    partial aggregation, so even a hot order is reduced before its shuffle.
    Orders without lines keep a row with an empty diff (zero statistics).
    """
    li = (table(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
          .groupBy("l_orderkey", "l_linenumber")
          # flag as a small int so the aggregate stays hash-based (min over strings is not)
          .agg(F.sum("l_quantity").cast("int").alias("qty"),
               F.min(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
                      .when(F.col("l_returnflag") == "R", 2).otherwise(3)).alias("flag_rank"),
               F.count_if(F.col("l_linestatus") == "O").alias("n_open"),
               F.count_if(F.col("l_linestatus") == "F").alias("n_final")))
    kind = (F.when(F.col("flag_rank") == 0, F.lit("new")).when(F.col("flag_rank") == 2, F.lit("deleted"))
             .otherwise(F.lit("modified")))
    path = F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit("/"),
                    F.col("l_linenumber").cast("string"), F.lit(".txt"))
    # qty lines "unit"; markers: new '+', deleted '-', modified cycling ' ', '+', '-'.
    # Built with native repeat/substring (no per-line lambda).
    n = F.greatest(F.col("qty"), F.lit(1))
    body = (F.when(F.col("kind") == "new", F.repeat(F.lit("+unit\n"), n))
             .when(F.col("kind") == "deleted", F.repeat(F.lit("-unit\n"), n))
             .otherwise(F.expr("substring(repeat(' unit\\n+unit\\n-unit\\n', "
                               "cast((greatest(qty, 1) + 2) div 3 as int)), 1, 6 * greatest(qty, 1))")))
    files = (li.withColumn("kind", kind).withColumn("path", path)
               .withColumn("section", file_section(F.col("path"), F.col("path"), F.col("kind"),
                                                   F.lit(False), F.lit(""), F.col("l_linenumber"),
                                                   body=body, n_lines=n))
               .groupBy("l_orderkey")
               .agg(F.sum("n_open").alias("n_open"), F.sum("n_final").alias("n_final"),
                    F.array_join(F.transform(
                   F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("k"),
                                                        F.col("section").alias("s")))),
                   lambda x: x["s"]), "").alias("diff")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    # the diff side grows with the data: always a sort-merge join, never a
    # broadcast chosen from a size estimate (whatever the session's settings)
    return (orders.join(files.hint("merge"), orders.o_orderkey == files.l_orderkey, "left")
                  .select(F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("repo"),
                          F.col("o_orderkey").cast("string").alias("changeset_id"),
                          F.coalesce(F.col("diff"), F.lit("")).alias("diff"),
                          # work-tree state of the change-set (A3): open lines are staged,
                          # final lines are unstaged; urgent orders auto-stage
                          F.coalesce(F.col("n_open"), F.lit(0)).cast("int").alias("n_index_changes"),
                          F.coalesce(F.col("n_final"), F.lit(0)).cast("int").alias("n_working_changes"),
                          F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("auto_stage")))


def doc_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of the documents corpus: one row per (lang, source)."""
    d = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return d.select(F.concat(F.col("lang"), F.lit("/"), F.col("source")).alias("repo"), "lang", "source")


def settings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_SETTINGS: explicit settings for some repositories only, so the rest
    need defaults; includes an out-of-enum language and an out-of-range limit."""
    r = doc_repos(spark, sf_dir)
    n = F.regexp_extract(F.col("source"), r"(\d+)", 1).cast("int")
    r = r.withColumn("n", n).filter(F.col("n") % 4 != 3)
    language = (F.when(F.col("n") % 8 == 5, F.lit("fr")).when(F.col("lang") == "es", F.lit("es"))
                 .when(F.col("n") % 2 == 0, F.lit("en")))
    model = F.when(F.col("n") % 2 == 0, F.lit("gemini-2.5-flash"))
    limit = (F.when(F.col("n") % 10 == 7, F.lit(500)).when(F.col("n") % 3 == 0, F.lit(1000))
              .when(F.col("n") % 3 == 1, F.lit(20000))).cast("bigint")
    return r.select("repo", language.alias("language"), model.alias("model"), limit.alias("token_limit"))


# Fixture parameters for the part-derived catalogue (not the reference's lists).
CATALOG_INCLUDE = ("ring", "widget", "gear")
CATALOG_EXCLUDE = ("small", "hot-")


def _model_name(p_name: Column, partkey: Column) -> Column:
    return F.concat(F.regexp_replace(p_name, " ", "-"), F.lit("-"), partkey.cast("string"))


def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_CATALOG: one catalogue per brand, one model per part."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    methods = (F.when(pk % 3 == 0, F.lit(None).cast("array<string>"))
                .when(pk % 3 == 1, F.array(F.lit("countTokens")))
                .otherwise(F.array(F.lit("countTokens"), F.lit("generateContent"))))
    display = (F.when(F.floor(pk / 3) % 3 == 0, F.lit(None).cast("string"))
                .when(F.floor(pk / 3) % 3 == 1, F.lit("")).otherwise(F.col("p_brand")))
    return p.select(F.col("p_brand").alias("catalog_id"),
                    F.concat(F.lit("models/"), _model_name(F.col("p_name"), pk)).alias("name"),
                    display.alias("display_name"), F.col("p_type").alias("description"),
                    methods.alias("methods"))


def catalog_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority table derived from the data: parts of size 48-50, larger first."""
    p = table(spark, sf_dir, "part").filter(F.col("p_size") >= 48)
    return p.select(((50 - F.col("p_size")).cast("bigint") * 1_000_000_000_000 + F.col("p_partkey"))
                    .alias("priority_rank"),
                    _model_name(F.col("p_name"), F.col("p_partkey")).alias("name"))


def catalog_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured model per catalogue: the brand's highest part key (may be ineligible)."""
    p = table(spark, sf_dir, "part")
    return (p.groupBy(F.col("p_brand").alias("catalog_id"))
             .agg(F.max_by(_model_name(F.col("p_name"), F.col("p_partkey")), F.col("p_partkey"))
                  .alias("current_model")))


def answers_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_RESPONSES, successes: assistant turns wrapped in spaces/quotes by ``conv_id``."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    w = F.col("conv_id") % 4
    raw = (F.when(F.col("conv_id") % 11 == 0, F.lit(' "" '))
            .when(w == 0, F.concat(F.lit("  \n"), F.col("text"), F.lit(" \n")))
            .when(w == 1, F.concat(F.lit('"'), F.col("text"), F.lit('"')))
            .when(w == 2, F.concat(F.lit("'"), F.col("text")))
            .otherwise(F.col("text")))
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                             F.col("turn").cast("string")).alias("request_id"),
                    F.lit("gemini-flash-latest").alias("model"), raw.alias("text"))


# Fixture error messages, chosen so every class and every precedence pair occurs.
ERROR_MESSAGES = ("API_KEY_INVALID: the key was rejected", "PERMISSION_DENIED: caller lacks access",
                  "RESOURCE_EXHAUSTED: too many requests", "daily quota exceeded",
                  "MODEL_NOT_FOUND: no such model", "INVALID_ARGUMENT: bad generation config",
                  "network error: ECONNREFUSED", "")
ERROR_STATUSES = (400, 403, 429, 404, 500, 0, None)


def errors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_RESPONSES, failures: one error per event, fields chosen by ``props.k``."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    statuses = F.array(*[F.lit(s).cast("int") for s in ERROR_STATUSES])
    messages = F.array(*[F.lit(m) for m in ERROR_MESSAGES])
    return (e.withColumn("k", k).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(F.col("k") % 2 == 0, F.lit("gemini-flash-latest")).otherwise(F.lit("gemini-2.5-flash"))
         .alias("model"),
        F.element_at(messages, (F.floor(F.col("k") / 7) % 8 + 1).cast("int")).alias("error_message"),
        F.element_at(statuses, (F.col("k") % 7 + 1).cast("int")).alias("status"),
        F.when(F.col("k") % 5 == 0, F.lit(404)).when(F.col("k") % 5 == 1, F.lit(429)).cast("int")
         .alias("response_status"),
        F.when(F.col("event_type").isin("error", "view"), F.concat(F.lit("upstream: "), F.col("event_type")))
         .alias("response_error_message"),
        F.when(F.col("event_type") == "click", F.lit("retry later"))
         .when(F.col("event_type") == "signup", F.lit("")).alias("details"),
        F.when(F.col("user_id") % 5 == 0, F.lit("es")).otherwise(F.lit("en")).alias("language"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("catalog_id"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit(' "'), _retry_message(F.col("event_id")), F.lit('" ')))
         .alias("retry_text")))


def _retry_message(event_id: Column) -> Column:
    """Answers of retries, by event: every rule of the message format is kept by some
    and broken by others. A third of the releases (1,000 events) has features, a
    third fixes, a third neither."""
    n, v, third = event_id.cast("string"), event_id % 16, F.floor(event_id / 1000) % 3
    return (F.when((v == 0) & (third == 0), F.concat(F.lit("feat: handle request "), n))
            .when((v == 1) & (third == 0), F.concat(F.lit("feat(api)!: replace the handling of request "), n))
            .when((v == 2) & (third == 1), F.concat(F.lit("fix(core): answer request "), n))
            .when(v == 3, F.concat(F.lit("docs: Describe request "), n))
            .when(v == 4, F.concat(F.lit("refactor(core): reorder the steps of request "), n, F.lit(".")))
            .when(v == 5, F.concat(F.lit("style: "), F.repeat(F.lit("wide "), F.lit(14)), n))
            .when(v == 6, F.concat(F.lit("perf: speed up request "), n, F.lit("\n\n"), F.repeat(F.lit("long "), F.lit(16)), F.lit("line")))
            .when(v == 7, F.concat(F.lit("chore: clean up request "), n, F.lit("\n\nShort body.\n- one point")))
            .when(v == 8, F.concat(F.lit("feature: a type of its own for request "), n))
            .when(v == 9, F.concat(F.lit("request "), n, F.lit(" without a type")))
            .when(v == 10, F.concat(F.lit("revert!: undo request "), n))
            .when(third == 2, F.concat(F.lit("test: cover request "), n))
            .otherwise(F.concat(F.lit("fix: regenerated answer for request "), n)))


def request_targets(spark: SparkSession, sf_dir: str, request_id: Column, doc_id: Column, source: DataFrame) -> DataFrame:
    """(request_id, repo, changeset_id) of the rows of ``source``: each asks for the
    change-set of one document; NULL where there is no such document."""
    repo = F.concat(F.col("lang"), F.lit("/"), F.col("source"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", repo.alias("repo"), F.concat(repo, F.lit("#"), F.floor(F.col("doc_id") / DOC_BLOCK).cast("string")).alias("changeset_id"))
    return source.select(request_id.alias("request_id"), doc_id.alias("doc_id")).join(docs, "doc_id", "left").drop("doc_id")


def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine events ask for each document, in order, so all change-sets are asked
    for; the last events ask for unknown ones."""
    return request_targets(spark, sf_dir, F.concat(F.lit("e"), F.col("event_id").cast("string")), F.floor(F.col("event_id") / 9),
                           table(spark, sf_dir, "events").select("event_id"))


def answer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a conversation go to the change-set of one document, or of none."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return request_targets(spark, sf_dir, F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")),
                           F.col("conv_id") * 11, c.select("conv_id", "turn"))


def exact_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(changeset_id, exact_tokens) for the change-sets whose source has an even number:
    a count that only a tokenizer would know, here a fifth of their characters."""
    d = table(spark, sf_dir, "documents").filter(F.regexp_extract("source", r"(\d+)", 1).cast("int") % 2 == 0)
    changeset = F.concat("lang", F.lit("/"), "source", F.lit("#"), F.floor(F.col("doc_id") / DOC_BLOCK).cast("string"))
    return d.groupBy(changeset.alias("changeset_id")).agg(F.floor(F.sum(F.length("text")) / 5).alias("exact_tokens"))


def repos_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_REPOS: workspace = nation, its repositories = its suppliers."""
    s = table(spark, sf_dir, "supplier")
    ws = F.concat(F.lit("ws"), F.col("s_nationkey").cast("string"))
    return s.select(ws.alias("workspace"), F.col("s_suppkey").alias("repo_pos"),
                    F.concat(F.lit("file:///"), ws, F.lit("/"), F.col("s_name")).alias("root_uri"))


def workspaces_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("ws"), F.col("n_nationkey").cast("string")).alias("workspace"))


def requests_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_REPOS requests: one per customer; the requested URI by ``c_custkey % 4``:
    none / the workspace's first repo / its last repo / the first with a trailing slash."""
    r = repos_table(spark, sf_dir)
    ends = (r.groupBy("workspace").agg(F.min_by("root_uri", "repo_pos").alias("first_uri"),
                                       F.max_by("root_uri", "repo_pos").alias("last_uri")))
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("ws"), F.col("c_nationkey").cast("string")).alias("workspace"))
    m = F.col("request_id") % 4
    uri = (F.when(m == 1, F.col("first_uri")).when(m == 2, F.col("last_uri"))
            .when(m == 3, F.concat(F.col("first_uri"), F.lit("/"))))
    return c.join(ends, "workspace", "left").select("request_id", "workspace", uri.alias("requested_uri"))


def releases_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_RELEASE: a version per part from brand number, size and key."""
    p = table(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    version = F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size").cast("string"),
                          (pk % 100).cast("string"))
    bump = F.element_at(F.array(F.lit("major"), F.lit("minor"), F.lit("patch")), (pk % 3 + 1).cast("int"))
    explicit = F.when(pk % 7 == 0, F.concat(F.lit("9.9."), pk.cast("string")))
    return p.select(F.concat(F.lit("pkg-"), pk.cast("string")).alias("package"), version.alias("version"),
                    bump.alias("bump"), explicit.alias("explicit_version"))


MODELS_PAGE = 100


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-list API responses: the catalogue as JSON pages of at most
    ``MODELS_PAGE`` models (bounded groups), plus one response without a
    ``models`` key for every catalogue whose first part key is even, plus, by page
    number, an earlier attempt (1) that failed: cut off, answered with a status of
    500, or with a model without a name."""
    cat = model_catalog(spark, sf_dir).withColumn(
        "k", F.regexp_extract("name", r"-(\d+)$", 1).cast("bigint"))
    pages = (cat.groupBy("catalog_id", F.floor(F.col("k") / MODELS_PAGE).alias("page"))
                .agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(
                    F.col("k").alias("_k"), F.col("name"), F.col("display_name").alias("displayName"),
                    F.col("description"), F.col("methods").alias("supportedGenerationMethods")))).alias("models")))
                    .alias("body")))
    pages = pages.withColumn("body", F.regexp_replace("body", r'"_k":\d+,', ""))
    empty = (cat.groupBy("catalog_id").agg(F.min("k").alias("k0"))
                .filter(F.col("k0") % 2 == 0)
                .select("catalog_id", F.lit(-1).cast("bigint").alias("page"), F.lit("{}").alias("body")))
    good = pages.unionByName(empty).select("catalog_id", "page", F.lit(0).alias("attempt"), F.lit(200).alias("status"), "body")
    kind = F.col("page") % 4
    failed = pages.filter(kind > 0).select(
        "catalog_id", "page", F.lit(1).alias("attempt"), F.when(kind == 2, F.lit(500)).otherwise(F.lit(200)).alias("status"),
        F.when(kind == 1, F.expr("substring(body, 1, length(body) - 2)"))
         .when(kind == 3, F.lit('{"models":[{"supportedGenerationMethods":["generateContent"]}]}')).otherwise(F.col("body")).alias("body"))
    return good.unionByName(failed)


def part_changesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F_PARTS: change-set = (part, order block); one new file per (part, order)
    with one added line per unit of quantity (duplicate pairs summed).
    Exercises the change-count threshold on real data."""
    li = (table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
          .groupBy("l_partkey", "l_orderkey")
          .agg(F.sum("l_quantity").cast("int").alias("qty")))
    n = F.greatest(F.col("qty"), F.lit(1))
    path = F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), F.lit("/"),
                    F.col("l_orderkey").cast("string"), F.lit(".txt"))
    files = (li.withColumn("path", path)
               .withColumn("changeset_id", F.concat(F.col("l_partkey").cast("string"), F.lit("#"),
                                                    F.floor(F.col("l_orderkey") / ORDER_BLOCK).cast("string")))
               .withColumn("repo", F.concat(F.lit("part/"), F.col("l_partkey").cast("string")))
               .withColumn("section", file_section(F.col("path"), F.col("path"), F.lit("new"), F.lit(False),
                                                   F.lit(""), F.lit(1), body=F.repeat(F.lit("+unit\n"), n),
                                                   n_lines=n)))
    return assemble(files, "l_orderkey", lambda c: F.concat(F.lit("part/"), F.substring_index(c, "#", 1)))
