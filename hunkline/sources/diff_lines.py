"""Diff files scanned line by line (A2, distributed form).

``wholetext`` makes a diff file one row, so one task. Here the text source
reads the files split into ``\\n``-terminated lines (``lineSep`` keeps any
``\\r`` in the line, as the reference's ``split('\\n')`` does), so one
enormous file is read by many tasks. Every later step is also distributed:

* section numbers are a prefix count of section markers, computed per input
  split (block) and carried across blocks by a per-file table with one row
  per block;
* a physical line is cut where a marker follows ``\\r``/U+2028/U+2029 inside
  it (the reference splits there too);
* per-section counts use a two-level aggregation: per (section, block),
  then per section over its blocks, so no single group holds a whole
  section;
* the file listing (name, length) is joined to the per-file results, which are
  narrow: empty files keep a row of zeros, and the length tells whether the last
  line has a newline (the reader's lines do not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hunkline.functions import utf16_length
from hunkline.operators.parse import BINARY_MARK, header_paths, is_addition, is_deletion
from hunkline.sources.diff_files import below, list_diff_files, read_options

MARKER = "diff --git "
# a marker inside one physical line: at its start, or after \r, U+2028, U+2029
IN_LINE_SPLIT = r"(?:\A|(?<=[\r\x{2028}\x{2029}]))diff --git "
SCHEMA = "value STRING"


def _pieces(line: Column) -> Column:
    special = (line.startswith(MARKER) | line.contains("\r") | line.contains("\u2028")
               | line.contains("\u2029"))
    return F.when(special, F.split(line, IN_LINE_SPLIT, -1)).otherwise(F.array(line))


def diff_line_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(file, blk, mid, j, section_no, piece)``: every
    line piece with its file-wide section number (0 = text before the first
    marker). ``(blk, mid, j)`` orders pieces within a file."""
    t = read_options(spark, SCHEMA).option("lineSep", "\n").text(path)
    t = t.select(below(path, F.col("_metadata.file_path")).alias("file"),
                 F.col("_metadata.file_block_start").alias("blk"),
                 F.monotonically_increasing_id().alias("mid"), "value")
    t = t.withColumn("pieces", _pieces(F.col("value"))).withColumn("n_marks", F.size("pieces") - 1)
    w = (Window.partitionBy("file", "blk").orderBy("mid")
         .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("m_local", F.coalesce(F.sum("n_marks").over(w), F.lit(0)))
    blocks = t.groupBy("file", "blk").agg(F.sum("n_marks").alias("b_marks"))
    wf = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("m_before", F.coalesce(F.sum("b_marks").over(wf), F.lit(0)))
    t = t.join(blocks.select("file", "blk", "m_before"), ["file", "blk"])
    return t.select("file", "blk", "mid", "value",
                    F.posexplode("pieces").alias("j", "piece"),
                    (F.col("m_before") + F.col("m_local")).alias("s0")) \
            .withColumn("section_no", F.col("s0") + F.col("j")).drop("s0")


def _starts(piece: Column, mark: str) -> Column:
    return piece.startswith(mark)


def diff_file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per diff file: kept files, additions, deletions (reference semantics)
    and the file's UTF-16 length, without ever holding a file in one row."""
    p = diff_line_pieces(spark, path)
    order = F.struct("blk", "mid", "j")
    # running count of '@@' lines per (section, block): a line is in a hunk
    # locally once one appeared earlier in the same block
    wl = (Window.partitionBy("file", "blk", "section_no").orderBy("mid", "j")
          .rowsBetween(Window.unboundedPreceding, -1))
    is_hdr = F.col("piece").startswith("@@")
    p = p.withColumn("h_prev", F.coalesce(F.sum(is_hdr.cast("int")).over(wl), F.lit(0)))
    add, dele = is_addition(F.col("piece")), is_deletion(F.col("piece"))
    per_block = (p.groupBy("file", "section_no", "blk")
                  .agg(F.min_by("piece", order).alias("first_piece"),
                       F.min(order).alias("first_key"),
                       F.count_if(is_hdr).alias("n_hdr"),
                       F.count_if(add).alias("a_all"), F.count_if(dele).alias("d_all"),
                       F.count_if(add & (F.col("h_prev") > 0)).alias("a_in"),
                       F.count_if(dele & (F.col("h_prev") > 0)).alias("d_in"),
                       F.bool_or(_starts(F.col("piece"), BINARY_MARK)).alias("f_bin"),
                       # UTF-16 units of the physical lines (counted on their first piece)
                       F.sum(F.when(F.col("j") == 0, utf16_length("value") + 1)).alias("u"),
                       F.sum(F.when(F.col("j") == 0, F.octet_length("value") + 1)).alias("bytes")))
    # blocks before the section's first '@@' contribute nothing, the block
    # holding it contributes what follows it, later blocks contribute all
    ws = Window.partitionBy("file", "section_no").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("h_before", F.coalesce(F.sum("n_hdr").over(ws), F.lit(0)))
    a = F.when(F.col("h_before") > 0, F.col("a_all")).otherwise(F.col("a_in"))
    d = F.when(F.col("h_before") > 0, F.col("d_all")).otherwise(F.col("d_in"))
    sections = (per_block.groupBy("file", "section_no")
                         .agg(F.min_by("first_piece", "first_key").alias("header"),
                              F.sum(a).alias("adds"), F.sum(d).alias("dels"),
                              F.coalesce(F.sum("u"), F.lit(0)).alias("u"),
                              F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
                              F.bool_or("f_bin").alias("is_binary")))
    # section 0 is the text before the first marker (empty pieces are no section)
    old, new = header_paths(F.col("header"))
    kept = (F.length(new) > 0) & ((F.col("section_no") > 0) | (F.length(F.col("header")) > 0))
    sections = sections.withColumn("kept", kept)
    files = (sections.groupBy("file")
                     .agg(F.count_if("kept").alias("f"),
                          F.sum(F.when(F.col("kept") & ~F.col("is_binary"), F.col("adds"))).alias("a"),
                          F.sum(F.when(F.col("kept") & ~F.col("is_binary"), F.col("dels"))).alias("d"),
                          F.sum("u").alias("u"), F.sum("bytes").alias("bytes")))
    # each line was counted with a newline; the last may have none (then the file is a
    # byte shorter), and a byte order mark that the reader skipped makes it three longer
    surplus = F.col("size") - F.coalesce("bytes", F.lit(0))
    units = F.coalesce("u", F.lit(0)) - F.when(surplus.isin(-1, 2), 1).otherwise(0) + F.when(surplus >= 2, 1).otherwise(0)
    return list_diff_files(spark, path).join(files, "file", "left").select(
        "changeset_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in (
            ("f", "total_files"), ("a", "total_additions"), ("d", "total_deletions"))], units.cast("bigint").alias("diff_units"))
