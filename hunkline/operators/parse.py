"""Row-local unified-diff parser.

One change-set row (a whole diff string) becomes an ``ARRAY<STRUCT>`` of
files with higher-order array functions, so parsing needs no shuffle and runs
unchanged in Structured Streaming. The flat, one-row-per-line form with hunk
ids and line numbers lives in :mod:`hunkline.operators.lines`.

Semantics follow the reference parser exactly (``strict`` behaviour):

* sections split at ``diff --git `` where it starts a line (after ``\\n``,
  ``\\r``, U+2028 or U+2029); empty sections are dropped;
* the header ``a/<old> b/<new>`` is matched on the first line with ``$`` as
  the absolute end, so a CRLF header does not match and the file is dropped;
* status flags look at every line of the section;
* lines are classified only after the first ``@@`` line and never in binary
  sections; ``+++``/``---`` prefixed lines are not changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line-start and header patterns of the unified diff format.
LINE_BREAKS = r"\n\r\x{2028}\x{2029}"
# literal first so Java's regex engine can skip ahead with a fast literal search; the
# fixed-width negative lookbehind then demands a line break (or the text start) before it
SECTION_SPLIT = r"diff --git (?<![^" + LINE_BREAKS + r"]diff --git )"
HEADER = r"a/([^" + LINE_BREAKS + r"]*?) b/([^" + LINE_BREAKS + r"]*?)\z"
HUNK_START = r"@@ -\d+,?\d* \+(\d+),?\d* @@"
NEW_MARK = "new file mode"
DELETED_MARK = "deleted file mode"
BINARY_MARK = "Binary files"
RENAME_MARK = "rename from"

ADDITION, DELETION, CONTEXT = "addition", "deletion", "context"

MAX_INT = 2147483647


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_addition(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def is_deletion(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def is_context(line: Column) -> Column:
    return line.startswith(" ")


def change_type(line: Column) -> Column:
    return (F.when(is_addition(line), F.lit(ADDITION))
            .when(is_deletion(line), F.lit(DELETION))
            .when(is_context(line), F.lit(CONTEXT)))


def change_text(line: Column) -> Column:
    """``line.substring(1)``: drop the one-character marker."""
    return line.substr(F.lit(2), F.lit(MAX_INT))


def sections(diff) -> Column:
    """B1: file sections of a diff, empty pieces removed (a missing diff is empty)."""
    return F.filter(F.split(F.coalesce(_c(diff), F.lit("")), SECTION_SPLIT, -1), lambda s: F.length(s) > 0)


def section_lines(section: Column) -> Column:
    """B2: ``split('\\n')`` keeping trailing empty strings and any ``\\r``."""
    return F.split(section, "\n", -1)


def header_paths(first_line: Column) -> tuple[Column, Column]:
    """(old path, new path); both '' when the header does not match.

    Without ``\r``/U+2028/U+2029 in the line, the lazy pattern reduces to:
    from the first ``a/``, old = up to the first following `` b/``, new = the
    rest (no match if there is no such `` b/``). That case uses plain
    ``instr``/``substr``; lines with those characters use the regex.
    """
    line = first_line
    plain = ~(line.contains("\r") | line.contains("\u2028") | line.contains("\u2029"))
    i = F.instr(line, "a/")
    rest = line.substr(i + 2, F.lit(MAX_INT))
    j = F.instr(rest, " b/")
    hit = (i > 0) & (j > 0)
    old_fast = F.when(hit, rest.substr(F.lit(1), j - 1)).otherwise(F.lit(""))
    new_fast = F.when(hit, rest.substr(j + 3, F.lit(MAX_INT))).otherwise(F.lit(""))
    return (F.when(plain, old_fast).otherwise(F.regexp_extract(line, HEADER, 1)),
            F.when(plain, new_fast).otherwise(F.regexp_extract(line, HEADER, 2)))


# Fixed value: text from the first line that starts with "@@" on (hunk state never ends in a section)
HUNK_TEXT = r"(?s)\n(@@.*)"


def _nl(text: Column) -> Column:
    return F.concat(F.lit("\n"), text)


def _starts_a_line(text: Column, mark: str) -> Column:
    """Some line of ``text`` (split on ``\n``) starts with ``mark``: plain substring search."""
    return text.startswith(mark) | text.contains("\n" + mark)


def hunk_text(section: Column) -> Column:
    """Everything from the first ``@@`` line on; ``@@`` lines start with none
    of ``+ - space``, so they never classify.
    (One regex with a literal start; faster than char-position ``instr``/``substr``.)"""
    return F.regexp_extract(_nl(section), HUNK_TEXT, 1)


def hunk_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hunk_start(line: Column) -> Column:
    """The new-file start that a hunk header gives; NULL if it gives none."""
    return F.when(line.startswith("@@"), F.nullif(F.regexp_extract(line, HUNK_START, 1), F.lit("")).try_cast("bigint"))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use``
    refers to it (a lambda's body is not searched for common parts)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stage_section(sec: Column, pos: Column) -> Column:
    old, new = header_paths(F.substring_index(sec, "\n", 1))
    is_binary = _starts_a_line(sec, BINARY_MARK)
    return F.struct(
        pos.alias("file_pos"), old.alias("old"), new.alias("path"),
        is_binary.alias("is_binary"),
        _starts_a_line(sec, NEW_MARK).alias("is_new"),
        _starts_a_line(sec, DELETED_MARK).alias("is_deleted"),
        _starts_a_line(sec, RENAME_MARK).alias("rename_mark"),
        # the hunks' lines, split once and reused by both counts and ``changes``
        F.when(is_binary, F.array().cast("array<string>"))
         .otherwise(hunk_lines(hunk_text(sec))).alias("lines"))


FILE_FIELDS = ["file_no", "file_pos", "path", "old_path", "is_binary", "is_new", "is_deleted",
               "is_renamed"]


def _numbered_changes(lines: Column) -> Column:
    """B8 + B10: classified lines in order, with new-file line numbers. The lines are
    cut at headers that give a start (0 before the first); additions and context
    lines of a stretch are numbered by their place among themselves, deletions have
    no number, and the stretch is put back in line order. Nothing is appended to a
    running result, so the work is linear but for that sort."""
    starts = F.filter(F.transform(lines, lambda l, i: F.struct(i.alias("at"), hunk_start(l).alias("start"))),
                      lambda h: h["start"].isNotNull())
    cuts = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("start"))), starts)

    def stretch(cuts: Column, k: Column, cut: Column) -> Column:
        end = F.coalesce(F.get(cuts, k + 1)["at"], F.size(lines))
        own = F.transform(F.slice(lines, cut["at"] + 2, end - cut["at"] - 1), lambda l, i: F.struct(
            i.alias("at"), change_type(l).alias("change_type"), change_text(l).alias("line")))
        numbered = F.transform(F.filter(own, lambda c: c["change_type"].isin(ADDITION, CONTEXT)), lambda c, i: F.struct(
            c["at"].alias("at"), c["change_type"].alias("change_type"), c["line"].alias("line"), (cut["start"] + i).alias("line_number")))
        deleted = F.transform(F.filter(own, lambda c: c["change_type"] == DELETION), lambda c: F.struct(
            c["at"].alias("at"), c["change_type"].alias("change_type"), c["line"].alias("line"),
            F.lit(None).cast("bigint").alias("line_number")))
        return F.sort_array(F.concat(numbered, deleted))

    ordered = bind(cuts, lambda all_cuts: F.flatten(F.transform(all_cuts, lambda cut, k: stretch(all_cuts, k, cut))))
    return F.transform(ordered, lambda c: F.struct(c["change_type"].alias("change_type"), c["line"].alias("line"),
                                                   c["line_number"].alias("line_number")))


def _stage_file(f: Column, no: Column, with_changes: bool, line_numbers: bool = False) -> Column:
    lines = f["lines"]
    fields = [
        (no + 1).alias("file_no"), f["file_pos"].alias("file_pos"), f["path"].alias("path"),
        F.nullif(f["old"], f["path"]).alias("old_path"),
        f["is_binary"].alias("is_binary"), f["is_new"].alias("is_new"),
        f["is_deleted"].alias("is_deleted"),
        ((f["old"] != f["path"]) | f["rename_mark"]).alias("is_renamed"),
        F.size(F.filter(lines, is_addition)).cast("bigint").alias("additions"),
        F.size(F.filter(lines, is_deletion)).cast("bigint").alias("deletions"),
    ]
    if with_changes and line_numbers:
        fields.append(_numbered_changes(lines).alias("changes"))
    elif with_changes:
        changes = F.transform(
            F.filter(lines, lambda l: is_addition(l) | is_deletion(l) | is_context(l)),
            lambda l: F.struct(change_type(l).alias("change_type"), change_text(l).alias("line")))
        fields.append(changes.alias("changes"))
    return F.struct(*fields)


def parse_files_col(diff, with_changes: bool = True, line_numbers: bool = False) -> Column:
    """B1-B10 as one expression: ``ARRAY<STRUCT<file_no, file_pos, path, ...>>``.

    ``file_pos`` is the 0-based section index; ``file_no`` is the 1-based rank
    among kept files (header matched, non-empty path). A section's hunk lines
    are split once, for the counts and for ``changes`` (optional), whose entries
    carry ``line_number`` (NULL for deletions) with ``line_numbers``.
    """
    secs = F.filter(F.transform(sections(diff), _stage_section), lambda f: F.length(f["path"]) > 0)
    return F.transform(secs, lambda f, i: _stage_file(f, i, with_changes, line_numbers))


def parse_files(df: DataFrame, diff_col: str = "diff", out_col: str = "files",
                with_changes: bool = True, line_numbers: bool = True) -> DataFrame:
    """Add the parsed ``files`` array column (row-local, no shuffle)."""
    return df.withColumn(out_col, parse_files_col(diff_col, with_changes, line_numbers))


def explode_files(df: DataFrame, keys: list[str], files_col: str = "files") -> DataFrame:
    """Flat ``files`` table: one row per kept file (still no shuffle)."""
    return df.select(*keys, F.inline(files_col))
