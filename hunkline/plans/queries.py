"""Registered queries: ``(spark, sf_dir) -> DataFrame``, one per operator family.

Each query derives its input from the driver tables (so its work grows with
them), runs the library transforms, and returns flat rows with the same
column names as the matching oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.functions import estimate_tokens, utf16_length
from hunkline.operators.compact import (
    BLOCK_FIELDS, DEFAULT_LINES, ROUTED_LINES, file_block, meaningful, process_diffs, stats_line,
    status_label, status_line, summary_col, with_meaningful,
)
from hunkline.operators.lines import all_section_lines, change_lines, file_hunks, numbered_lines
from hunkline.operators.parse import parse_files, parse_files_col, sections
from hunkline.operators.stats import (
    MAX_CHANGES, MAX_FILES, MAX_TOKENS, rollup_by, with_is_large, with_stats,
)
from hunkline.operators.catalog import (
    best_model, eligible_models, mark_current, model_order, models_from_response, response_rejects,
)
from hunkline.operators.lookup import lookup
from hunkline.operators.release import conformance, next_version, parse_subject, release_bump, version_chain
from hunkline.operators.repos import (
    changeset_disposition, default_repository, match_repository, repo_candidates,
)
from hunkline.operators.respond import (
    classify_errors, clean_responses, final_outcomes, retry_plan, with_retry_model,
)
from hunkline.operators.prompt import prompt_col, resolve_settings, token_gate
from hunkline.sources.fixtures import (
    CATALOG_EXCLUDE, CATALOG_INCLUDE, answer_targets, answers_table, catalog_current, errors_table, catalog_priority,
    doc_changesets, doc_repos, event_targets, exact_token_counts, model_catalog, model_responses, order_changesets, part_changesets, releases_table, repos_table, requests_table, settings_table,
    workspaces_table,
)
from hunkline.sources.diff_files import scan_diff_files, write_diff_files
from hunkline.sources.diff_lines import diff_file_stats
from hunkline.sources.tables import table
from hunkline.sources.message_sink import read_messages, write_messages
from hunkline.streaming.incremental import (
    PROCESSED_COLUMNS, REQUESTS, dedupe_requests, process_stream, request_keys, scratch_path, staged_copy, suppress_stream,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def reg(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return reg


@query("process_diffs")
def q_process_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (H6): parse -> stats -> size test -> summary or raw diff."""
    out = process_diffs(doc_changesets(spark, sf_dir))
    return out.select("changeset_id", "total_files", "total_additions", "total_deletions",
                      "total_changes", F.col("diff_tokens").alias("estimated_tokens"),
                      "was_compacted", F.md5("content").alias("content_md5"))


# --- parsing (B1-B11) on the documents corpus ----------------------------------------------

def _docs(spark, sf_dir, by_source_only=False):
    return doc_changesets(spark, sf_dir, by_source_only)


@query("process_diffs_by_file")
def q_process_diffs_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 with every large-by-tokens change-set on the file-by-file route
    (the route enormous diffs take); same answer as ``process_diffs``."""
    out = process_diffs(doc_changesets(spark, sf_dir), split_over_bytes=0)
    return out.select("changeset_id", "total_files", "total_additions", "total_deletions",
                      "total_changes", F.col("diff_tokens").alias("estimated_tokens"),
                      "was_compacted", F.md5("content").alias("content_md5"))


@query("file_sections")
def q_file_sections(spark, sf_dir):
    """B1: sections of every diff, with their position."""
    cs = _docs(spark, sf_dir)
    return (cs.select("changeset_id", F.posexplode(sections("diff")).alias("file_pos", "section"))
              .select("changeset_id", "file_pos", F.md5("section").alias("section_md5"),
                      utf16_length("section").alias("section_units")))


@query("section_lines")
def q_section_lines(spark, sf_dir):
    """B2: every line of every section (``split('\\n')``, trailing '' kept)."""
    return all_section_lines(_docs(spark, sf_dir))


def _parsed(spark, sf_dir, with_changes=False, by_source_only=False):
    cs = _docs(spark, sf_dir, by_source_only)
    return cs.select("changeset_id", F.inline(parse_files_col("diff", with_changes)))


@query("parsed_files")
def q_parsed_files(spark, sf_dir):
    """Kept files in diff order with flags and counts (flat form)."""
    return _parsed(spark, sf_dir, True).select(
        "changeset_id", "file_no", "file_pos", "path", "old_path", "is_binary", "is_new",
        "is_deleted", "is_renamed", "additions", "deletions",
        F.size("changes").cast("bigint").alias("n_changes"))


@query("file_headers")
def q_file_headers(spark, sf_dir):
    """Header paths and rename-by-path."""
    return _parsed(spark, sf_dir).select("changeset_id", "file_no", "path", "old_path", "is_renamed")


@query("file_flags")
def q_file_flags(spark, sf_dir):
    """Status flags from any line of the section."""
    return _parsed(spark, sf_dir).select("changeset_id", "file_no", "is_new", "is_deleted",
                                         "is_binary", "is_renamed")


@query("file_counts")
def q_file_counts(spark, sf_dir):
    """Additions and deletions per file."""
    return _parsed(spark, sf_dir).select("changeset_id", "file_no", "additions", "deletions")


@query("file_status")
def q_file_status(spark, sf_dir):
    """New > deleted > renamed > modified, with the summary's status line."""
    f = F.struct(*[F.col(c) for c in ("is_new", "is_deleted", "is_renamed", "old_path")])
    return _parsed(spark, sf_dir).select("changeset_id", "file_no", status_label(f).alias("status"),
                                         status_line(f).alias("status_line"))


@query("hunks")
def q_hunks(spark, sf_dir):
    """Hunks with header position, parsed new-file start and counts."""
    return file_hunks(_docs(spark, sf_dir))


@query("line_changes")
def q_line_changes(spark, sf_dir):
    """Classified change lines (marker removed)."""
    return change_lines(_docs(spark, sf_dir))


@query("change_line_numbers")
def q_change_line_numbers(spark, sf_dir):
    """Every entry of the nested result's ``changes``, with its line number."""
    files = _docs(spark, sf_dir).select("changeset_id", F.inline(parse_files_col("diff", True, line_numbers=True)))
    return (files.select("changeset_id", "file_no", F.posexplode("changes").alias("k", "c"))
            .select("changeset_id", "file_no", "k", "c.change_type", "c.line", "c.line_number"))


@query("line_numbers")
def q_line_numbers(spark, sf_dir):
    """New-file line numbers of additions and context lines."""
    return (numbered_lines(_docs(spark, sf_dir)).filter(F.col("line_number").isNotNull())
            .select("changeset_id", "file_no", "line_pos", "change_type", "line_number"))


@query("line_numbers_blocked")
def q_line_numbers_blocked(spark, sf_dir):
    """B8 as a distributed prefix computation over 64-line blocks (the form
    that lets one enormous file be numbered by many tasks)."""
    return (numbered_lines(_docs(spark, sf_dir), block_lines=64).filter(F.col("line_number").isNotNull())
            .select("changeset_id", "file_no", "line_pos", "change_type", "line_number"))


@query("diff_stats")
def q_diff_stats(spark, sf_dir):
    """E2/B11 on the orders corpus: empty change-sets keep a row of zeros."""
    cs = order_changesets(spark, sf_dir)
    return with_stats(parse_files(cs, with_changes=False)).select(
        "changeset_id", "total_files", "total_additions", "total_deletions", "total_changes")


@query("estimate_tokens")
def q_estimate_tokens(spark, sf_dir):
    """UTF-16 length and ceil(length / 2.5) of every document text."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", utf16_length("text").alias("utf16_units"),
                    estimate_tokens("text").alias("estimated_tokens"))


@query("is_large")
def q_is_large(spark, sf_dir):
    """C2 on the by-source corpus (exactly 50 files per change-set at sf0.01: not large by files)."""
    cs = _docs(spark, sf_dir, by_source_only=True)
    out = with_is_large(with_stats(parse_files(cs, with_changes=False)))
    return out.select("changeset_id", "total_files", "total_changes",
                      F.col("diff_tokens").alias("estimated_tokens"),
                      (F.col("total_files") > MAX_FILES).alias("large_by_files"),
                      (F.col("total_changes") > MAX_CHANGES).alias("large_by_changes"),
                      (F.col("diff_tokens") > MAX_TOKENS).alias("large_by_tokens"), "is_large")


@query("is_large_parts")
def q_is_large_parts(spark, sf_dir):
    """C2 on the parts corpus: the change-count threshold (> 500, strict)."""
    cs = part_changesets(spark, sf_dir)
    out = with_is_large(with_stats(parse_files(cs, with_changes=False)))
    return out.select("changeset_id", "total_files", "total_changes",
                      F.col("diff_tokens").alias("estimated_tokens"),
                      (F.col("total_files") > MAX_FILES).alias("large_by_files"),
                      (F.col("total_changes") > MAX_CHANGES).alias("large_by_changes"),
                      (F.col("diff_tokens") > MAX_TOKENS).alias("large_by_tokens"), "is_large")


@query("meaningful_changes")
def q_meaningful_changes(spark, sf_dir):
    """Per file, changes that are not context and not blank after a JS trim."""
    return _parsed(spark, sf_dir, True).select(
        "changeset_id", "file_no", F.size(meaningful(F.col("changes"))).cast("bigint").alias("n_meaningful"))


@query("top_changes")
def q_top_changes(spark, sf_dir):
    """first 15 meaningful changes per file, with the overflow count."""
    p = _parsed(spark, sf_dir, True).select("changeset_id", "file_no",
                                            meaningful(F.col("changes")).alias("m"))
    return (p.select("changeset_id", "file_no",
                     F.greatest(F.size("m") - ROUTED_LINES, F.lit(0)).cast("bigint").alias("n_more"),
                     F.posexplode(F.slice("m", 1, ROUTED_LINES)).alias("k", "c"))
             .select("changeset_id", "file_no", (F.col("k") + 1).alias("k"),
                     F.col("c.change_type").alias("change_type"), F.col("c.line").alias("line"), "n_more"))


@query("summary_stats_line")
def q_summary_stats_line(spark, sf_dir):
    """H1: statistics line with singular/plural forms."""
    s = with_stats(parse_files(_docs(spark, sf_dir), with_changes=False))
    return s.select("changeset_id", stats_line(F.col("total_files"), F.col("total_additions"),
                                               F.col("total_deletions")).alias("stats_line"))


@query("file_blocks")
def q_file_blocks(spark, sf_dir):
    """H2/H3: each file's summary block at the function default of 20 lines."""
    cs = _docs(spark, sf_dir)
    files = with_meaningful(parse_files_col("diff", True))
    return (cs.select("changeset_id", F.inline(files))
              .select("changeset_id", "file_no",
                      F.md5(file_block(F.struct(*[F.col(c) for c in BLOCK_FIELDS]), DEFAULT_LINES))
                      .alias("block_md5")))


@query("compact_summary")
def q_compact_summary(spark, sf_dir):
    """H4: the whole compact summary of every change-set (N = 20)."""
    s = with_stats(parse_files(_docs(spark, sf_dir), line_numbers=False))
    summ = summary_col(F.col("files"), F.col("total_files"), F.col("total_additions"),
                       F.col("total_deletions"), DEFAULT_LINES)
    return s.select("changeset_id", F.md5(summ).alias("summary_md5"),
                    utf16_length(summ).alias("summary_units"))


# --- settings, prompts, token gate (D4, H5, H7, C5, E4, H8) ---------------------------------

def _resolved(spark, sf_dir):
    return resolve_settings(doc_repos(spark, sf_dir).select("repo"), settings_table(spark, sf_dir))


@query("resolve_settings")
def q_resolve_settings(spark, sf_dir):
    """Settings with defaults for every repository."""
    return _resolved(spark, sf_dir)


def _prompts(spark, sf_dir):
    """Prompts for every change-set. Settings come by a measured lookup of the
    repository, so content is not shuffled for them."""
    routed = lookup(process_diffs(_docs(spark, sf_dir)), _resolved(spark, sf_dir), "repo")
    return routed.withColumn("prompt", prompt_col("content", "language", "was_compacted",
                                                  "total_files", "total_changes"))


@query("build_prompts")
def q_build_prompts(spark, sf_dir):
    """H5/H7: rendered prompt per change-set (language from settings)."""
    return _prompts(spark, sf_dir).select(
        "changeset_id", "language", "was_compacted", F.md5("prompt").alias("prompt_md5"),
        utf16_length("prompt").alias("prompt_units"))


@query("token_gate")
def q_token_gate(spark, sf_dir):
    """Prompt tokens (exact where known, else estimated) against the repo's limit."""
    known = lookup(_prompts(spark, sf_dir), exact_token_counts(spark, sf_dir), "changeset_id")
    g = token_gate(known, exact_col="exact_tokens")
    return g.select("changeset_id", "exact_tokens", "prompt_tokens", "token_limit", "gate", "notice", "large_notice")


# --- model catalogue (I1-I6, F3, F4) --------------------------------------------------------

def _eligible(spark, sf_dir):
    return eligible_models(model_catalog(spark, sf_dir), include=CATALOG_INCLUDE, exclude=CATALOG_EXCLUDE)


@query("model_catalog_json")
def q_model_catalog_json(spark, sf_dir):
    """A5: models parsed back from JSON list responses (missing list -> none)."""
    m = models_from_response(model_responses(spark, sf_dir), "body", ["catalog_id", "page"], "status")
    return m.select("catalog_id", "name", "display_name", "description",
                    F.size(F.coalesce("methods", F.array().cast("array<string>"))).alias("n_methods"))


@query("model_rejects")
def q_model_rejects(spark, sf_dir):
    """A5: the responses that were turned down, and why."""
    r = response_rejects(model_responses(spark, sf_dir), "body", ["catalog_id", "page", "attempt"], "status")
    return r.select("catalog_id", "page", "attempt", "status", "reason")


@query("model_eligible")
def q_model_eligible(spark, sf_dir):
    """Capability and name filters, normalised names."""
    return _eligible(spark, sf_dir).select("catalog_id", "name", "display_name", "description")


@query("model_order")
def q_model_order(spark, sf_dir):
    """locale order of names within each catalogue (skew-safe position)."""
    return model_order(_eligible(spark, sf_dir)).select("catalog_id", "name", "pos")


@query("model_current")
def q_model_current(spark, sf_dir):
    """Flag each catalogue's configured model."""
    m = mark_current(_eligible(spark, sf_dir), catalog_current(spark, sf_dir))
    return m.select("catalog_id", "name", "is_current")


@query("best_model")
def q_best_model(spark, sf_dir):
    """Best model per catalogue: priority, else first, else fallback."""
    cats = table(spark, sf_dir, "part").select(F.col("p_brand").alias("catalog_id")).distinct()
    return best_model(_eligible(spark, sf_dir), cats, catalog_priority(spark, sf_dir))


# --- responses and errors (G1-G6, C4) -------------------------------------------------------

@query("clean_responses")
def q_clean_responses(spark, sf_dir):
    """G1/C4: trimmed, unquoted answers; empty ones flagged."""
    return clean_responses(answers_table(spark, sf_dir)).select("request_id", "message", "has_message")


@query("classify_errors")
def q_classify_errors(spark, sf_dir):
    """Normalised error, class (first rule wins), retry flag, user text."""
    return classify_errors(errors_table(spark, sf_dir)).select(
        "request_id", "error_class", "error_status", "retry", "user_text")


def _best_per_catalog(spark, sf_dir):
    cats = table(spark, sf_dir, "part").select(F.col("p_brand").alias("catalog_id")).distinct()
    return best_model(_eligible(spark, sf_dir), cats, catalog_priority(spark, sf_dir))


@query("retry_plan")
def q_retry_plan(spark, sf_dir):
    """Model-not-found requests retried with their catalogue's best model and
    the prompt they failed with."""
    errors = classify_errors(errors_table(spark, sf_dir)).join(
        event_targets(spark, sf_dir).select("request_id", "changeset_id"), "request_id", "left")
    plan = retry_plan(errors, _best_per_catalog(spark, sf_dir), prompts=_prompts(spark, sf_dir))
    return plan.select("request_id", "failed_model", "retry_model", "changeset_id", F.md5("prompt").alias("prompt_md5"),
                       utf16_length("prompt").alias("prompt_units"))


@query("final_outcomes")
def q_final_outcomes(spark, sf_dir):
    """Message or error per request, after at most one retry."""
    errs = with_retry_model(classify_errors(errors_table(spark, sf_dir)), _best_per_catalog(spark, sf_dir))
    return final_outcomes(clean_responses(answers_table(spark, sf_dir)), errs)


# --- repositories (D1-D3, E5, A3) and roll-up (E6) ------------------------------------------

@query("match_repository")
def q_match_repository(spark, sf_dir):
    """Requested URI -> first equal repo, else the only repo, else ambiguous/none."""
    m = match_repository(requests_table(spark, sf_dir), repos_table(spark, sf_dir))
    return m.select("request_id", "workspace", "requested_uri", "n_repos", "outcome", "matched_uri",
                    "matched_pos")


@query("repo_candidates")
def q_repo_candidates(spark, sf_dir):
    """Pick list per workspace that has ambiguous requests (once per workspace)."""
    repos = repos_table(spark, sf_dir)
    return repo_candidates(match_repository(requests_table(spark, sf_dir), repos), repos)


@query("default_repository")
def q_default_repository(spark, sf_dir):
    """D3: position-0 repository of every workspace."""
    return default_repository(workspaces_table(spark, sf_dir), repos_table(spark, sf_dir))


@query("eligible_changesets")
def q_eligible_changesets(spark, sf_dir):
    """A3: disposition of every order change-set before any text is sent."""
    cs = changeset_disposition(order_changesets(spark, sf_dir))
    return cs.select("changeset_id", "n_index_changes", "n_working_changes", "auto_stage",
                     "disposition", "eligible")


@query("repo_rollup")
def q_repo_rollup(spark, sf_dir):
    """Change-set statistics summed per repository."""
    p = process_diffs(_docs(spark, sf_dir)).withColumn("is_large", F.col("was_compacted"))
    return rollup_by(p, ["repo"])


# --- releases and message conformance (J1-J4) -----------------------------------------------

@query("next_version")
def q_next_version(spark, sf_dir):
    """Next version per package (explicit wins, else bump)."""
    return next_version(releases_table(spark, sf_dir)).select(
        "package", "version", "bump", "explicit_version", "next_version")


def _final_messages(spark, sf_dir):
    fo = q_final_outcomes(spark, sf_dir).filter(F.col("outcome") == "message")
    num = F.regexp_extract("request_id", r"^[ce](\d+)", 1).cast("bigint")
    rel = F.when(F.col("request_id").startswith("c"), F.concat(F.lit("conv-"), F.floor(num / 10).cast("string"))) \
           .otherwise(F.concat(F.lit("events-"), F.floor(num / 1000).cast("string")))
    return fo.select("request_id", F.col("final_text").alias("message"), rel.alias("release"))


@query("parse_subject")
def q_parse_subject(spark, sf_dir):
    """J3 (specification-derived): type, scope, breaking flag, description."""
    return parse_subject(_final_messages(spark, sf_dir)).select(
        "request_id", "commit_type", "scope", "breaking", "description")


@query("subject_conformance")
def q_subject_conformance(spark, sf_dir):
    """J4 (specification-derived): per-message checks of the commit rules."""
    return conformance(parse_subject(_final_messages(spark, sf_dir))).select(
        "request_id", "type_ok", "length_ok", "lowercase_ok", "no_period_ok", "wrapped_ok", "conforms")


@query("release_bump")
def q_release_bump(spark, sf_dir):
    """J2 (specification-derived): bump per release from its commit types."""
    return release_bump(parse_subject(_final_messages(spark, sf_dir))).select(
        "release", "n_commits", "bump")


@query("release_versions")
def q_release_versions(spark, sf_dir):
    """J2 -> J1: the version of every release, bump after bump."""
    bumps = release_bump(parse_subject(_final_messages(spark, sf_dir)))
    releases = bumps.select(F.substring_index("release", "-", 1).alias("package"),
                            F.substring_index("release", "-", -1).cast("bigint").alias("ordinal"), "bump")
    return version_chain(releases, start="1.4.2").select("package", "ordinal", "bump", "version")


# --- streaming (K1, K2), diff-file source (A2), message sink (A4) ---------------------------

@query("stream_process")
def q_stream_process(spark, sf_dir):
    """K1: the flagship as a Structured Streaming job (availableNow) over the
    change-set table written to the shared folder; returns the sink table."""
    src = staged_copy(_docs(spark, sf_dir), spark, "stream_src")
    out, ckpt = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_ckpt")
    process_stream(spark, src, out, ckpt).awaitTermination()
    return spark.read.parquet(out).select(*PROCESSED_COLUMNS)


def _requests(spark, sf_dir):
    """Requests from events: each asks for the change-set of one document, so all
    change-sets are asked for; the last events ask for unknown ones."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request_id"), "ts")
    req = event_targets(spark, sf_dir).join(e, "request_id").select("request_id", "ts", "changeset_id")
    return request_keys(req, _docs(spark, sf_dir))


@query("dedupe_requests")
def q_dedupe_requests(spark, sf_dir):
    """K2: one kept request per (repo, diff content, 10-minute window)."""
    return dedupe_requests(_requests(spark, sf_dir))


def request_arrivals(requests: DataFrame) -> DataFrame:
    """When requests reach the stream: in spans of 15 days, every tenth one span late;
    one request of each kind a span (which of two equal ones arrives first is not defined)."""
    number = F.substring("request_id", 2, 20).cast("bigint")
    arrival = F.floor(F.unix_date(F.to_date("ts")) / 15) + F.when(number % 10 == 9, 1).otherwise(0)
    unknown = F.when(F.col("repo").isNull() | F.col("diff_sha").isNull(), F.col("request_id"))
    first = F.min_by(F.struct("request_id", F.col("ts").cast("timestamp").alias("ts")), F.struct("ts", number))
    return (requests.groupBy(arrival.alias("arrival"), "repo", "diff_sha", unknown.alias("unknown")).agg(first.alias("r"))
            .select("arrival", "r.request_id", "repo", "diff_sha", "r.ts"))


@query("stream_dedupe")
def q_stream_dedupe(spark, sf_dir):
    """K2 as a stream with a state store: one run for each arrival, restarted from its
    checkpoint, with late requests and kept ones that expire."""
    staged = spark.read.parquet(staged_copy(request_arrivals(_requests(spark, sf_dir)), spark, "arrivals"))
    src, out, ckpt = (scratch_path(spark, f"dedupe_{n}") for n in ("src", "out", "ckpt"))
    for (arrival,) in staged.select("arrival").distinct().orderBy("arrival").collect():
        staged.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(src)
        suppress_stream(spark, src, out, ckpt, delay="2 days").awaitTermination()
    return spark.read.schema(REQUESTS).parquet(out).select(
        "request_id", "repo", "diff_sha", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("requested_at"))


def _diff_files(spark, sf_dir):
    """The documents corpus written as diff files under the shared folder."""
    path = scratch_path(spark, "diff_files")
    write_diff_files(_docs(spark, sf_dir), path)
    return path


@query("scan_diff_files")
def q_scan_diff_files(spark, sf_dir):
    """A2: change-sets written as diff files, scanned back whole and parsed."""
    files = scan_diff_files(spark, _diff_files(spark, sf_dir))
    s = with_stats(parse_files(files, with_changes=False))
    return s.select("changeset_id", "total_files", "total_additions", "total_deletions",
                    utf16_length("diff").alias("diff_units"))


@query("scan_diff_lines")
def q_scan_diff_lines(spark, sf_dir):
    """A2, distributed form: the same diff files read line by line (splittable),
    sections numbered by a block-wise prefix, counts by two-level aggregation."""
    return diff_file_stats(spark, _diff_files(spark, sf_dir)).select(
        "changeset_id", "total_files", "total_additions",
                                               "total_deletions", "diff_units")


@query("message_sink")
def q_message_sink(spark, sf_dir):
    """A4: final outcomes written to the sink of message boxes, the conversations'
    answers first, the events' after them; returns the sink."""
    path = scratch_path(spark, "messages")
    outcomes = q_final_outcomes(spark, sf_dir)
    number = [F.regexp_extract("request_id", r"^[ce](\d+)(?:-(\d+))?", i).try_cast("bigint") for i in (1, 2)]
    for prefix, targets in (("c", answer_targets(spark, sf_dir)), ("e", event_targets(spark, sf_dir))):
        mine = outcomes.filter(F.col("request_id").startswith(prefix)).join(targets, "request_id", "left")
        write_messages(mine.withColumn("seq", F.struct(*number)), path)
    return read_messages(spark, path, outcome=None).select(
        "repo", "changeset_id", "request_id", "outcome", "error_class", "model_used", "message")
