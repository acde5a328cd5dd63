"""Release and message-conformance operators.

J1 is implemented in the reference (a PowerShell release script); J2-J4 are
only *specified* there (README and prompt text): nothing in the reference
parses or checks a message. They are built here from that specification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkline.operators.rank import position_within

# Conventional Commits types named by the reference (10 in the
# prompt, plus ``revert`` in the README), subject limit, and the bump mapping.
COMMIT_TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "chore", "build", "ci",
                "revert")
MAX_SUBJECT = 72
WRAP = 72
TYPE_BUMP = {"feat": "minor", "fix": "patch"}
SUBJECT = r"^(\w+)(?:\(([^)]*)\))?(!)?: (.+)$"


def next_version(df: DataFrame, version: str = "version", bump: str = "bump",
                 explicit: str = "explicit_version") -> DataFrame:
    """An explicit version wins; otherwise bump ``x.y.z`` (default patch)
    and zero the lower parts. Non-numeric parts give NULL (the script fails)."""
    parts = F.split(F.col(version), r"\.")
    major, minor, patch = (F.expr(f"try_cast(element_at(split({version}, '[.]'), {i}) AS INT)")
                           for i in (1, 2, 3))
    b = F.coalesce(F.nullif(F.col(bump), F.lit("")), F.lit("patch"))
    bumped = (F.when(b == "major", F.concat_ws(".", (major + 1).cast("string"), F.lit("0"), F.lit("0")))
               .when(b == "minor", F.concat_ws(".", major.cast("string"), (minor + 1).cast("string"), F.lit("0")))
               .otherwise(F.concat_ws(".", major.cast("string"), minor.cast("string"),
                                      (patch + 1).cast("string"))))
    valid = (F.size(parts) >= 3) & major.isNotNull() & minor.isNotNull() & patch.isNotNull()
    return df.withColumn("next_version", F.when(F.length(F.coalesce(F.col(explicit), F.lit(""))) > 0,
                                                F.col(explicit)).when(valid, bumped))


CHAIN_BLOCK = 10_000    # releases numbered by one task


def version_chain(releases: DataFrame, start: str = "0.0.0", package: str = "package", order: str = "ordinal",
                  bump: str = "bump", block: int = CHAIN_BLOCK) -> DataFrame:
    """J2 -> J1: the version of each release, from ``start`` on. Within a package the
    bumps are applied in ``order``: major resets minor and patch, minor resets patch,
    ``none`` (or an unknown bump) keeps the version.

    A segmented prefix: the releases of a package are cut into blocks of ``block``
    positions, parts are counted since the block's last reset, block summaries (one row
    per block) are carried along the package, and added to rows that have seen no reset in
    their block. A package with a third of all releases is numbered by many tasks.
    ``order`` must be a total order within the package.
    """
    base = [int(x) for x in start.split(".")]
    b = F.coalesce(F.col(bump), F.lit("none"))
    rows = position_within(releases, [package], [F.col(order)], out="_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / block))
    rows = rows.select("*", *[(b == name).cast("bigint").alias(f"_{name}") for name in ("major", "minor", "patch")])

    def runs(df: DataFrame, part: list[str], by: str, out: str) -> DataFrame:
        """Running (major, minor since a major, patch since either) by ``by`` in ``part``."""
        def over(*more: str):
            return Window.partitionBy(*part, *more).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)

        df = df.withColumn(f"{out}major", F.sum("_major").over(over()))
        df = df.withColumn(f"{out}minor", F.sum("_minor").over(over(f"{out}major")))
        return df.withColumn(f"{out}patch", F.sum("_patch").over(over(f"{out}major", f"{out}minor")))

    rows = runs(rows, [package, "_block"], "_pos", "_n")
    last = F.max_by(F.struct("_nmajor", "_nminor", "_npatch"), "_pos")
    ends = rows.groupBy(package, "_block").agg(last.alias("e"), F.max("_minor").alias("_any")).select(
        package, "_block", F.col("e._nmajor").alias("_major"), F.col("e._nminor").alias("_minor"), F.col("e._npatch").alias("_patch"), "_any")
    # a block's minors count since its last major, so a block with a major starts a
    # stretch of its own; likewise patches and blocks with a major or a minor
    along = Window.partitionBy(package).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (ends.withColumn("_smajor", F.sum("_major").over(along)).withColumn("_cmajor", F.sum(F.sign("_major")).over(along))
            .withColumn("_creset", F.sum(F.when((F.col("_major") > 0) | (F.col("_any") > 0), 1).otherwise(0)).over(along)))
    stretch_m = Window.partitionBy(package, "_cmajor").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretch_p = Window.partitionBy(package, "_creset").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (ends.withColumn("_sminor", F.sum("_minor").over(stretch_m) + F.when(F.col("_cmajor") == 0, base[1]).otherwise(0))
            .withColumn("_spatch", F.sum("_patch").over(stretch_p) + F.when(F.col("_creset") == 0, base[2]).otherwise(0)))
    carried = ends.select(package, (F.col("_block") + 1).alias("_block"), F.col("_smajor").alias("_bmajor"), F.col("_sminor").alias("_bminor"), F.col("_spatch").alias("_bpatch"))
    j = rows.join(carried, [package, "_block"], "left")
    major = F.col("_nmajor") + F.coalesce("_bmajor", F.lit(0)) + base[0]
    minor = F.col("_nminor") + F.when(F.col("_nmajor") == 0, F.coalesce("_bminor", F.lit(base[1]))).otherwise(0)
    patch = F.col("_npatch") + F.when((F.col("_nmajor") == 0) & (F.col("_nminor") == 0), F.coalesce("_bpatch", F.lit(base[2]))).otherwise(0)
    return j.select(*releases.columns, F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (major, minor, patch)]).alias("version"))


def subject_line(message) -> Column:
    c = F.col(message) if isinstance(message, str) else message
    return F.substring_index(c, "\n", 1)


def parse_subject(df: DataFrame, message: str = "message") -> DataFrame:
    """``<type>[optional scope][!]: <description>`` on the first line."""
    # the pattern runs once: its groups come back as lines, which a first line cannot hold
    groups = F.when(F.col("subject").rlike(SUBJECT),
                    F.split(F.regexp_replace("subject", SUBJECT, "$1\n$2\n$3\n$4"), "\n", 4))
    cols = [c for c in df.columns if c != "subject"]
    staged = (df.withColumn("subject", subject_line(message)).withColumn("_groups", groups))
    g = [F.get("_groups", i) for i in range(4)]
    return staged.select(*cols, "subject", g[0].alias("commit_type"), F.nullif(g[1], F.lit("")).alias("scope"),
                         (g[2] == "!").alias("breaking"), g[3].alias("description"))


def conformance(df: DataFrame, message: str = "message") -> DataFrame:
    """Type in the list, subject under 72 characters, lower-case start,
    no final period, body lines wrapped at 72."""
    body = F.when(F.col(message).contains("\n"),
                  F.expr(f"substring({message}, instr({message}, '\\n') + 1)")).otherwise(F.lit(""))
    first = F.substring(F.col("description"), 1, 1)
    return (df.withColumn("type_ok", F.coalesce(F.col("commit_type").isin(*COMMIT_TYPES), F.lit(False)))
              .withColumn("length_ok", F.length("subject") < MAX_SUBJECT)
              .withColumn("lowercase_ok", F.coalesce(first == F.lower(first), F.lit(False)))
              .withColumn("no_period_ok", ~F.col("subject").endswith("."))
              .withColumn("wrapped_ok", ~F.exists(F.split(body, "\n", -1), lambda l: F.length(l) > WRAP))
              .withColumn("conforms", F.col("type_ok") & F.col("length_ok") & F.col("lowercase_ok")
                          & F.col("no_period_ok") & F.col("wrapped_ok")))


def release_bump(parsed: DataFrame, release: str = "release") -> DataFrame:
    """Per release, ``feat`` -> minor, ``fix`` -> patch, other types no bump."""
    return (parsed.groupBy(release)
                  .agg(F.count(F.lit(1)).alias("n_commits"),
                       F.count_if(F.col("commit_type") == "feat").alias("n_feat"),
                       F.count_if(F.col("commit_type") == "fix").alias("n_fix"))
                  .withColumn("bump", F.when(F.col("n_feat") > 0, F.lit(TYPE_BUMP["feat"]))
                              .when(F.col("n_fix") > 0, F.lit(TYPE_BUMP["fix"])).otherwise(F.lit("none"))))
