"""Exploded form of the parser: one row per diff line, with hunk ids and
new-file line numbers (B2, B6, B7, B8).

Rows are produced by ``inline``/``posexplode`` (no shuffle); numbering is a
running window per ``(changeset_id, file_pos)``. When the input is already
hash-partitioned by ``changeset_id`` (as the corpus builders leave it) the
window adds no Exchange; otherwise it costs exactly one shuffle on narrow keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkline.operators.parse import (
    ADDITION, BINARY_MARK, CONTEXT, _starts_a_line, change_text, change_type,
    header_paths, hunk_start, is_addition, is_context, is_deletion, section_lines, sections,
)


def kept_sections_col(diff) -> Column:
    """Kept file sections (non-empty header path) with ``file_no`` and ``file_pos``."""
    secs = F.transform(sections(diff), lambda s, i: F.struct(
        i.alias("file_pos"), header_paths(F.substring_index(s, "\n", 1))[1].alias("path"),
        _starts_a_line(s, BINARY_MARK).alias("is_binary"), s.alias("section")))
    kept = F.filter(secs, lambda f: F.length(f["path"]) > 0)
    return F.transform(kept, lambda f, i: F.struct(
        (i + 1).alias("file_no"), f["file_pos"].alias("file_pos"), f["path"].alias("path"),
        f["is_binary"].alias("is_binary"), f["section"].alias("section")))


def all_section_lines(df: DataFrame, key: str = "changeset_id", diff_col: str = "diff") -> DataFrame:
    """B1+B2: every section (kept or not) and every line, with positions."""
    return (df.select(key, F.posexplode(sections(diff_col)).alias("file_pos", "section"))
              .select(key, "file_pos", F.posexplode(section_lines(F.col("section"))).alias("line_pos", "line")))


def _kept_lines(df: DataFrame, key: str, diff_col: str) -> DataFrame:
    return (df.select(key, F.inline(kept_sections_col(diff_col)))
              .select(key, "file_no", "is_binary", section_lines(F.col("section")).alias("lines")))


def change_lines(df: DataFrame, key: str = "changeset_id", diff_col: str = "diff") -> DataFrame:
    """The classified lines of kept files, marker removed. Row-local: a line
    classifies if it stands after the section's first ``@@`` line."""
    rows = _kept_lines(df, key, diff_col).filter(~F.col("is_binary")).withColumn(
        "first", F.array_position(F.transform("lines", lambda l: l.startswith("@@")), True))
    lines = rows.filter(F.col("first") > 0).select(key, "file_no", "first", F.posexplode("lines").alias("line_pos", "line"))
    return (lines.filter(F.col("line_pos") >= F.col("first")).withColumn("change_type", change_type(F.col("line")))
            .filter(F.col("change_type").isNotNull())
            .select(key, "file_no", "line_pos", "change_type", change_text(F.col("line")).alias("line")))


def file_hunks(df: DataFrame, key: str = "changeset_id", diff_col: str = "diff") -> DataFrame:
    """One row per hunk with its header's position, parsed start and counts.
    Row-local: a hunk is the slice of the section's lines up to the next ``@@`` line."""
    rows = _kept_lines(df, key, diff_col).withColumn("at", F.filter(
        F.transform("lines", lambda l, i: F.when(l.startswith("@@"), i)), lambda i: i.isNotNull()))
    each = rows.select(key, "file_no", "is_binary", "lines", "at", F.posexplode("at").alias("k", "header_pos"))
    end = F.coalesce(F.get("at", F.col("k") + 1), F.size("lines"))
    each = each.select(key, "file_no", (F.col("k") + 1).cast("bigint").alias("hunk_no"), "header_pos",
                       hunk_start(F.get("lines", F.col("header_pos"))).alias("new_start"),
                       F.when(F.col("is_binary"), F.array().cast("array<string>")).otherwise(
                           F.slice("lines", F.col("header_pos") + 2, end - F.col("header_pos") - 1)).alias("body"))
    count = {"additions": is_addition, "deletions": is_deletion, "context": is_context}
    return each.select(*[c for c in each.columns if c != "body"],
                       *[F.size(F.filter("body", test)).cast("bigint").alias(name) for name, test in count.items()])


def _line_rows(df: DataFrame, key: str, diff_col: str) -> DataFrame:
    rows = (df.select(key, F.inline(kept_sections_col(diff_col)))
              .select(key, "file_no", "file_pos", "is_binary",
                      F.posexplode(section_lines(F.col("section"))).alias("line_pos", "line")))
    is_hdr = F.col("line").startswith("@@")
    start = hunk_start(F.col("line"))
    # a line that would be numbered once inside a hunk: addition or context, not binary
    ctype = change_type(F.col("line"))
    return (rows.withColumn("is_hunk_header", is_hdr)
                .withColumn("hunk_start", start)
                .withColumn("_ctype", F.when(~is_hdr & ~F.col("is_binary"), ctype))
                .withColumn("_num", F.coalesce(F.col("_ctype").isin(ADDITION, CONTEXT), F.lit(False))))


def _finish(rows: DataFrame, key: str) -> DataFrame:
    number = F.when(F.col("numbered"),
                    F.coalesce(F.col("_s"), F.lit(0)) + F.col("cum") - 1 - F.coalesce(F.col("_c"), F.lit(0)))
    return rows.select(key, "file_no", "file_pos", "line_pos", "line", "is_hunk_header", "hunk_start",
                       "hunk_no", "change_type",
                       F.when(F.col("change_type").isNotNull(), change_text(F.col("line"))).alias("text"),
                       number.cast("bigint").alias("line_number"))


def numbered_lines(df: DataFrame, key: str = "changeset_id", diff_col: str = "diff",
                   block_lines: int | None = None) -> DataFrame:
    """B6-B8 over kept files: hunk number, change type and new-file line number per line.

    Line numbers follow the reference counter: 0 before any parsed hunk
    header, reset by each parsed ``@@ ... +N ... @@``, kept by an unparsable
    one, advanced by additions and context lines only.

    ``block_lines=None``: one running window per file. ``block_lines=K``:
    the same numbers as a distributed prefix computation, so one enormous
    file is numbered by many tasks. Each file is cut into blocks of K lines;
    windows run per block; a per-file table of block summaries (at most
    lines/K rows) carries the header count, the numbered count and the last
    parsed header across blocks; it is joined back by block.
    """
    rows = _line_rows(df, key, diff_col)
    if block_lines is None:
        w = (Window.partitionBy(key, "file_pos").orderBy("line_pos")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        r = rows.withColumn("hunk_no", F.sum(F.col("is_hunk_header").cast("int")).over(w))
        r = (r.withColumn("change_type", F.when(F.col("hunk_no") > 0, F.col("_ctype")))
              .withColumn("numbered", F.col("change_type").isin(ADDITION, CONTEXT)))
        cum = F.sum(F.col("numbered").cast("int")).over(w)
        base = F.last(F.when(F.col("hunk_start").isNotNull(),
                             F.struct(F.col("hunk_start").alias("s"), cum.alias("c"))), ignorenulls=True).over(w)
        r = r.withColumn("cum", cum).withColumn("_base", base)
        return _finish(r.withColumn("_s", F.col("_base.s")).withColumn("_c", F.col("_base.c")), key)
    return _finish(_blocked(rows, key, block_lines), key)


def _blocked(rows: DataFrame, key: str, k: int) -> DataFrame:
    blk = [key, "file_pos", "_blk"]
    wb = Window.partitionBy(*blk).orderBy("line_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hdr = F.col("is_hunk_header").cast("int")
    r = rows.withColumn("_blk", F.floor(F.col("line_pos") / k))
    r = (r.withColumn("_lh", F.sum(hdr).over(wb))                       # headers so far in block
          .withColumn("_na", F.sum(F.col("_num").cast("int")).over(wb)))  # candidates so far in block
    # candidates after the block's first header (numbered when no header came before the block)
    r = r.withColumn("_nh", F.sum(F.when(F.col("_lh") > 0, F.col("_num").cast("int")).otherwise(0)).over(wb))
    # last parsed header inside the block so far, with both candidate counts at that point
    r = r.withColumn("_lp", F.last(F.when(F.col("hunk_start").isNotNull(), F.struct(
        F.col("hunk_start").alias("s"), F.col("_na").alias("na"), F.col("_nh").alias("nh"))),
        ignorenulls=True).over(wb))
    summ = (r.groupBy(*blk)
             .agg(F.max("_lh").alias("b_h"), F.max("_na").alias("b_na"), F.max("_nh").alias("b_nh"),
                  F.max_by("_lp", "line_pos").alias("b_lp")))
    wf = Window.partitionBy(key, "file_pos").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("h_before", F.coalesce(F.sum("b_h").over(wf), F.lit(0)))
    summ = summ.withColumn("b_num", F.when(F.col("h_before") > 0, F.col("b_na")).otherwise(F.col("b_nh")))
    summ = summ.withColumn("n_before", F.coalesce(F.sum("b_num").over(wf), F.lit(0)))
    # the block's last parsed header as (start, numbered count up to it, file-wide)
    b_lp_c = F.col("n_before") + F.when(F.col("h_before") > 0, F.col("b_lp.na")).otherwise(F.col("b_lp.nh"))
    summ = summ.withColumn("b_hdr", F.when(F.col("b_lp").isNotNull(), F.struct(
        F.col("b_lp.s").alias("s"), b_lp_c.alias("c"))))
    summ = summ.withColumn("carry", F.last("b_hdr", ignorenulls=True).over(wf))
    j = r.join(summ.select(*blk, "h_before", "n_before", "carry"), blk)
    hunk_no = F.col("h_before") + F.col("_lh")
    j = (j.withColumn("hunk_no", hunk_no)
          .withColumn("change_type", F.when(F.col("hunk_no") > 0, F.col("_ctype")))
          .withColumn("numbered", F.col("change_type").isin(ADDITION, CONTEXT))
          .withColumn("cum", F.col("n_before") + F.when(F.col("h_before") > 0, F.col("_na"))
                      .otherwise(F.col("_nh"))))
    local_c = F.col("n_before") + F.when(F.col("h_before") > 0, F.col("_lp.na")).otherwise(F.col("_lp.nh"))
    return (j.withColumn("_s", F.when(F.col("_lp").isNotNull(), F.col("_lp.s")).otherwise(F.col("carry.s")))
             .withColumn("_c", F.when(F.col("_lp").isNotNull(), local_c).otherwise(F.col("carry.c"))))


def hunks(lines: DataFrame, key: str = "changeset_id") -> DataFrame:
    """One row per hunk with its header position, parsed start and counts."""
    # file_pos rides along (it determines file_no) so the grouping reuses the
    # window's (changeset_id, file_pos) partitioning on raw inputs too
    return (lines.filter(F.col("hunk_no") > 0)
                 .groupBy(key, "file_pos", "file_no", "hunk_no")
                 .agg(F.min("line_pos").alias("header_pos"),
                      F.max("hunk_start").alias("new_start"),
                      F.count_if(F.col("change_type") == "addition").cast("bigint").alias("additions"),
                      F.count_if(F.col("change_type") == "deletion").cast("bigint").alias("deletions"),
                      F.count_if(F.col("change_type") == "context").cast("bigint").alias("context"))
                 .drop("file_pos"))
