"""Compact summary rendering and size routing (row-local string building)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkline.functions import js_has_text, plural
from hunkline.operators.parse import (
    ADDITION, CONTEXT, _stage_file, _stage_section, bind, change_text, is_addition, is_deletion, sections,
)
from hunkline.operators.stats import MAX_CHANGES, MAX_FILES, MAX_TOKENS, is_large_col, stats_cols
from hunkline.functions import estimate_tokens

# Summary format strings that must equal the reference output.
SUMMARY_HEAD = "## Diff Summary\n\n"
STATS_LABEL = "**Statistics**: "
FILE_HEAD = "### "
STATUS_NEW = "**Status**: New file\n"
STATUS_DELETED = "**Status**: Deleted\n"
STATUS_RENAMED = "**Status**: Renamed from `"
TYPE_BINARY = "**Type**: Binary file\n\n"
CHANGES_LABEL = "**Changes**: +"
KEY_CHANGES_OPEN = "**Key changes**:\n```\n"
KEY_CHANGES_CLOSE = "```\n\n"
MORE_CHANGES = ("... and ", " more changes\n")
UNDEFINED = "undefined"

DEFAULT_LINES = 20      # function default
ROUTED_LINES = 15       # what the size router passes


def meaningful(changes: Column) -> Column:
    """Not context and not blank after a JavaScript trim."""
    return F.filter(changes, lambda c: (c["change_type"] != CONTEXT) & js_has_text(c["line"]))


def status_line(f: Column) -> Column:
    """New > deleted > renamed > nothing (``undefined`` if no old path)."""
    return (F.when(f["is_new"], F.lit(STATUS_NEW))
             .when(f["is_deleted"], F.lit(STATUS_DELETED))
             .when(f["is_renamed"], F.concat(F.lit(STATUS_RENAMED),
                                             F.coalesce(f["old_path"], F.lit(UNDEFINED)), F.lit("`\n")))
             .otherwise(F.lit("")))


def status_label(f: Column) -> Column:
    return (F.when(f["is_new"], F.lit("new")).when(f["is_deleted"], F.lit("deleted"))
             .when(f["is_renamed"], F.lit("renamed")).otherwise(F.lit("modified")))


def key_change_block(m: Column, n_meaningful: Column, n: int) -> Column:
    """H3 + F1 + F2: first ``n`` meaningful changes, overflow count, fences."""
    shown = F.array_join(F.transform(F.slice(m, 1, n), lambda c: F.concat(
        F.when(c["change_type"] == ADDITION, F.lit("+")).otherwise(F.lit("-")),
        F.lit(" "), c["line"], F.lit("\n"))), "")
    return _fenced(shown, n_meaningful, n)


def _fenced(shown: Column, n_meaningful: Column, n: int) -> Column:
    """F2 + fences around the lines shown."""
    more = F.when(n_meaningful > n, F.concat(F.lit(MORE_CHANGES[0]), (n_meaningful - n).cast("string"),
                                             F.lit(MORE_CHANGES[1]))).otherwise(F.lit(""))
    return F.when(n_meaningful > 0, F.concat(F.lit(KEY_CHANGES_OPEN), shown, more,
                                          F.lit(KEY_CHANGES_CLOSE))).otherwise(F.lit(""))


def with_meaningful(files: Column) -> Column:
    """Attach each file's meaningful changes (``m``) and their count (``n_m``) once."""
    return F.transform(files, lambda f: f.withField("m", meaningful(f["changes"]))).alias("files")


BLOCK_FIELDS = ["path", "old_path", "is_binary", "is_new", "is_deleted", "is_renamed", "additions",
                "deletions", "m"]


def file_block(f: Column, n: int) -> Column:
    """H2: one file's block of the compact summary (``f`` from ``with_meaningful``)."""
    body = F.when(f["is_binary"], F.lit(TYPE_BINARY)).otherwise(F.concat(
        F.lit(CHANGES_LABEL), f["additions"].cast("string"), F.lit(" -"),
        f["deletions"].cast("string"), F.lit("\n\n"), key_change_block(f["m"], F.size(f["m"]), n)))
    return F.concat(F.lit(FILE_HEAD), f["path"], F.lit("\n"), status_line(f), body)


def stats_line(total_files: Column, total_additions: Column, total_deletions: Column) -> Column:
    """H1: ``N files changed, A insertions(+), D deletions(-)`` with singulars."""
    return F.concat(plural(total_files, "file"), F.lit(" changed, "),
                    plural(total_additions, "insertion"), F.lit("(+), "),
                    plural(total_deletions, "deletion"), F.lit("(-)"))


def _summary_head(total_files: Column, total_additions: Column, total_deletions: Column) -> Column:
    return F.concat(F.lit(SUMMARY_HEAD + STATS_LABEL), stats_line(total_files, total_additions, total_deletions), F.lit("\n\n"))


def summary_col(files: Column, total_files: Column, total_additions: Column,
                total_deletions: Column, n: int = DEFAULT_LINES) -> Column:
    """H4: the whole compact summary of one change-set."""
    return F.concat(_summary_head(total_files, total_additions, total_deletions),
                    F.array_join(F.transform(with_meaningful(files), lambda f: file_block(f, n)), ""))


def _meaningful_lines(lines: Column) -> Column:
    """C1 on hunk lines (marker still on)."""
    return F.filter(lines, lambda l: (is_addition(l) | is_deletion(l)) & js_has_text(change_text(l)))


def block_from_lines(f: Column, lines: Column, n: int) -> Column:
    """H2 of a staged file from its hunk lines, each searched once."""
    def block(m: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(m, 1, n), lambda l: F.concat(
            l.substr(1, 1), F.lit(" "), change_text(l), F.lit("\n"))), "")
        body = F.when(f["is_binary"], F.lit(TYPE_BINARY)).otherwise(F.concat(
            F.lit(CHANGES_LABEL), f["additions"].cast("string"), F.lit(" -"), f["deletions"].cast("string"), F.lit("\n\n"),
            _fenced(shown, F.size(m), n)))
        return F.concat(F.lit(FILE_HEAD), f["path"], F.lit("\n"), status_line(f), body)

    return bind(_meaningful_lines(lines), block)


def _routed_files(diff_col: str, large_by_tokens: Column, n: int) -> Column:
    """The kept files of a diff, each hunk body extracted once: counts, and the
    file's block where the diff is large by tokens (its content is the summary
    whatever the files say), else its lines, from which the block can be built.
    Of a diff that is large by tokens, only one section's lines exist at a time."""
    def file(f: Column) -> Column:
        return bind(_stage_file(f, F.lit(0), with_changes=False), lambda g: F.struct(
            g.alias("g"),
            F.when(large_by_tokens, block_from_lines(g, f["lines"], n)).alias("block"),
            F.when(~large_by_tokens, f["lines"]).alias("lines"), f["path"].alias("path")))

    files = F.transform(sections(diff_col), lambda s, i: bind(_stage_section(s, i), file))
    return F.filter(files, lambda f: F.length(f["path"]) > 0)


def _route_row_local(df: DataFrame, diff_col: str, keys: list[str], lines_per_file: int,
                     max_files: int, max_changes: int, max_tokens: int) -> DataFrame:
    sized = df.select(*keys, diff_col, estimate_tokens(diff_col).alias("diff_tokens"))
    parsed = sized.withColumn("_files", _routed_files(diff_col, F.col("diff_tokens") > max_tokens, lines_per_file))
    s = parsed.select(*keys, diff_col, "_files", "diff_tokens", *stats_cols(F.transform("_files", lambda f: f["g"])))
    s = s.withColumn("total_changes", F.col("total_additions") + F.col("total_deletions"))
    s = s.withColumn("was_compacted", is_large_col(F.col("total_files"), F.col("total_changes"),
                                                   F.col("diff_tokens"), max_files, max_changes, max_tokens))
    blocks = F.array_join(F.transform("_files", lambda f: F.coalesce(
        f["block"], block_from_lines(f["g"], f["lines"], lines_per_file))), "")
    content = F.when(F.col("was_compacted"), F.concat(_summary_head(
        F.col("total_files"), F.col("total_additions"), F.col("total_deletions")), blocks)).otherwise(F.col(diff_col))
    return s.select(*keys, *OUT_STATS, content.alias("content"))


def _route_by_file(df: DataFrame, diff_col: str, keys: list[str], lines_per_file: int) -> DataFrame:
    """Large-by-tokens diffs, summarised file by file: sections are exploded
    in the task that holds the row, then spread over tasks by
    ``(changeset_id, file_pos)``; statistics and blocks come back through a
    partial aggregation keyed by the row's other columns and its diff's hash.
    Equal rows meet in one group: their number is the count of any one file
    position, by which the totals are divided and the result repeated, so the
    answer is that of the row-local route for any input (no row id is needed,
    which a retried task might number anew). The raw text is never needed
    again (a large diff's content is its summary)."""
    secs = (df.select(*keys, estimate_tokens(diff_col).alias("diff_tokens"), F.sha2(diff_col, 256).alias("_sha"),
                      F.posexplode_outer(sections(diff_col)).alias("file_pos", "section"))
              .repartition(*keys[:1], "file_pos"))
    f = secs.select(*keys, "diff_tokens", "_sha", "file_pos",
                    _stage_section(F.col("section"), F.col("file_pos")).alias("h"))
    g = f.select(*keys, "diff_tokens", "_sha", "file_pos", F.coalesce(F.length(F.col("h.path")) > 0, F.lit(False)).alias("kept"),
                 _stage_file(F.col("h"), F.lit(0), with_changes=False).alias("g"), F.col("h.lines").alias("lines"))
    blocks = g.select(*keys, "diff_tokens", "_sha", "file_pos", "kept", F.col("g.additions").alias("a"),
                      F.col("g.deletions").alias("d"),
                      F.when(F.col("kept"), F.struct(F.col("file_pos").alias("k"), block_from_lines(
                          F.col("g"), F.col("lines"), lines_per_file).alias("b"))).alias("kb"))
    copies = F.count_if(F.coalesce(F.col("file_pos"), F.lit(0)) == 0)

    def each(total: Column) -> Column:
        return (F.coalesce(total, F.lit(0)) / copies).cast("bigint")

    agg = (blocks.groupBy(*keys, "diff_tokens", "_sha")
                 .agg(each(F.count_if(F.col("kept"))).alias("total_files"),
                      each(F.sum(F.when(F.col("kept"), F.col("a")))).alias("total_additions"),
                      each(F.sum(F.when(F.col("kept"), F.col("d")))).alias("total_deletions"),
                      # one block per file position: the one output string of a change-set is
                      # the one thing that has to come together
                      F.array_join(F.transform(F.sort_array(F.collect_set("kb")), lambda x: x["b"]), "")
                       .alias("_blocks"), copies.cast("int").alias("_copies"))
                 .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))
    out = (agg.withColumn("total_changes", F.col("total_additions") + F.col("total_deletions"))
              .withColumn("was_compacted", F.lit(True)))
    head = _summary_head(F.col("total_files"), F.col("total_additions"), F.col("total_deletions"))
    return out.select(*keys, *OUT_STATS, F.concat(head, F.col("_blocks")).alias("content"))


OUT_STATS = ["total_files", "total_additions", "total_deletions", "total_changes", "diff_tokens",
             "was_compacted"]


def process_diffs(df: DataFrame, diff_col: str = "diff", lines_per_file: int = ROUTED_LINES,
                  max_files: int = MAX_FILES, max_changes: int = MAX_CHANGES,
                  max_tokens: int = MAX_TOKENS, split_over_bytes: int | None = None,
                  key: str = "changeset_id") -> DataFrame:
    """H6: parse, count, test size; large -> compact summary, else the raw diff.

    Output: the input's columns except ``diff_col``, the statistics,
    ``diff_tokens``, ``was_compacted`` and ``content``.

    Row-local: one scan, no shuffle, each hunk body extracted once. A diff that is
    large by tokens keeps its files' blocks only, one section's lines at a time, so
    an enormous diff needs little more memory than the row itself; a small diff
    keeps its lines, from which blocks are built if it turns out large otherwise.

    ``split_over_bytes`` spreads the parsing of enormous rows over tasks too: diffs
    above it that are large by tokens are split into sections where they are read,
    and their sections shuffled. It costs a second read of ``diff_col`` (the rows that
    are not split must not be shuffled), so it is off unless asked for.
    """
    keys = [key] + [c for c in df.columns if c not in (key, diff_col)]
    args = (lines_per_file, max_files, max_changes, max_tokens)
    # a missing diff is the empty diff (zero statistics), never a lost row
    df = df.withColumn(diff_col, F.coalesce(F.col(diff_col), F.lit("")))
    if split_over_bytes is None:
        return _route_row_local(df, diff_col, keys, *args)
    big = (estimate_tokens(diff_col) > max_tokens) & (F.octet_length(diff_col) > split_over_bytes)
    small = _route_row_local(df.filter(~big), diff_col, keys, *args)
    large = _route_by_file(df.filter(big), diff_col, keys, lines_per_file)
    return small.unionByName(large)
