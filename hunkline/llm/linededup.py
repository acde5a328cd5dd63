"""Line deduplication over windows of three consecutive lines.

DataFrame operations only:

1. A text's lines are hashed (128 bits, white space at both ends ignored), and
   each three consecutive non-blank lines make a window, overlapping the next.
2. Windows are aggregated by hash, before the shuffle and after it, to the first
   occurrence in the order of (id, text hash, line) and a count. A window that a
   third of all rows hold is one row from each task.
3. Windows join the repeated ones; every occurrence but the first covers its
   lines, from the window's first to its last, blank lines between included.
   Positions covered several times merge. Skewed keys of the join are split by
   adaptive execution.
4. The covered positions of a document join its row and its lines are removed.

Only hashes and positions are exploded; the text itself is shuffled once, to
meet its positions. Nothing is capped.

Defined cases: a null text stays null, with 0 lines. An empty text has one blank
line. Texts of fewer than three non-blank lines have no window and stay as they
are. A text whose lines all go becomes empty; the row stays. Rows are told apart
by id and text: rows equal in both are one occurrence and get the same result.
A null id sorts before all others. All columns of the input are kept, whatever
their names; ``n_lines`` and ``n_removed`` (or the names given for them) are added
and replace columns of those names, whatever their case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
BLANK = " \t\r\f\x0b"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _windows(rows: DataFrame) -> DataFrame:
    """(id, text_hash, first, last, w1, w2): every window of every text."""
    content = F.filter(
        F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(BLANK)).alias("line"))),
        lambda x: x["line"] != "")
    hashed = F.transform("content", lambda x: F.struct(
        x["i"].alias("i"), F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit(1), x["line"]).alias("b")))
    return (rows.select("id", "text_hash", content.alias("content")).filter(F.size("content") >= WINDOW)
            .select("id", "text_hash", hashed.alias("hashed"))
            .select("id", "text_hash", F.explode(F.transform(
                F.slice("hashed", F.lit(1), F.size("hashed") - (WINDOW - 1)),
                lambda x, k: F.struct(
                    x["i"].alias("first"), F.get(F.col("hashed"), k + (WINDOW - 1))["i"].alias("last"),
                    F.xxhash64(x["a"], *[F.get(F.col("hashed"), k + j)["a"] for j in range(1, WINDOW)]).alias("w1"),
                    F.xxhash64(x["b"], *[F.get(F.col("hashed"), k + j)["b"] for j in range(1, WINDOW)]).alias("w2")))).alias("w"))
            .select("id", "text_hash", "w.*"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", n_lines: str = "n_lines",
                n_removed: str = "n_removed") -> DataFrame:
    """``df`` with repeated line windows removed from ``text``, and the columns
    ``n_lines`` (before) and ``n_removed``."""
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}  # by place: names may differ in case only
    rows = df.toDF(*own.values())
    rows = rows.select(F.col(own[id_col]).alias("id"), F.xxhash64(own[text]).alias("text_hash"), F.col(own[text]).alias("text"),
                       F.struct(*own.values()).alias("row"))
    windows = _windows(rows.select("id", "text_hash", "text"))
    place = F.struct("id", "text_hash", "first")
    repeated = (windows.groupBy("w1", "w2").agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
                .filter(F.col("n") > 1).select("w1", "w2", "earliest"))
    # rows equal in id and text hold equal windows: they are one occurrence
    later = (windows.join(repeated, ["w1", "w2"]).filter(place != F.col("earliest"))
             .select("id", "text_hash", F.struct("first", "last").alias("span")))
    covered = (later.groupBy("id", "text_hash").agg(F.collect_set("span").alias("spans"))
               .select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"),
                       F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))).alias("gone")))
    joined = rows.join(covered, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    lines = _lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    added = {n_lines: F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
             n_removed: F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")}
    replaced = {name.lower() for name in added}
    return joined.select(*[cleaned.alias(c) if c == text else F.col("row")[own[c]].alias(c) for c in df.columns if c.lower() not in replaced],
                         *[v.alias(k) for k, v in added.items()])
