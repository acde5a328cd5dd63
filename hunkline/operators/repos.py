"""Repository matching (D1-D3, E5) and change-set eligibility (A3).

``repos(workspace, repo_pos, root_uri, ...)`` lists the repositories open in
each workspace; ``requests(request_id, workspace, requested_uri NULL)`` are
generate-commands. Matching is two lookups in per-workspace aggregates
(partial aggregation map-side), never a request x repository product; the
requests themselves are not shuffled while the aggregates are of a measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkline.operators.lookup import lookup

MATCHED, SINGLE, AMBIGUOUS, NONE = "matched", "single_fallback", "ambiguous", "none"


def workspace_summary(repos: DataFrame) -> DataFrame:
    """E5 + D3: repositories per workspace and the first one (position order)."""
    return (repos.groupBy("workspace")
                 .agg(F.count(F.lit(1)).alias("n_repos"),
                      F.min_by("root_uri", "repo_pos").alias("first_uri"),
                      F.min("repo_pos").alias("first_pos")))


def match_repository(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """No repos -> none; an exactly equal URI -> the first such repo;
    else exactly one repo -> it; else ambiguous (the caller asks the user)."""
    firsts = (repos.groupBy("workspace", F.col("root_uri").alias("requested_uri"))
                   .agg(F.min("repo_pos").alias("match_pos")))
    # requests stay where they are; a request without a URI equals no repository
    j = lookup(lookup(requests, firsts, ["workspace", "requested_uri"]), workspace_summary(repos), "workspace")
    n = F.coalesce(F.col("n_repos"), F.lit(0))
    outcome = (F.when(n == 0, F.lit(NONE))
                .when(F.col("match_pos").isNotNull(), F.lit(MATCHED))
                .when(n == 1, F.lit(SINGLE))
                .otherwise(F.lit(AMBIGUOUS)))
    return (j.withColumn("n_repos", n.cast("bigint"))
             .withColumn("outcome", outcome)
             .withColumn("matched_uri", F.when(F.col("outcome") == MATCHED, F.col("requested_uri"))
                         .when(F.col("outcome") == SINGLE, F.col("first_uri")))
             .withColumn("matched_pos", F.when(F.col("outcome") == MATCHED, F.col("match_pos"))
                         .when(F.col("outcome") == SINGLE, F.col("first_pos")))
             .drop("match_pos", "first_uri", "first_pos"))


def repo_candidates(matches: DataFrame, repos: DataFrame) -> DataFrame:
    """The pick list for workspaces with ambiguous requests: every repo
    once per workspace (label = last path segment, full path), with the
    number of requests waiting on that list."""
    waiting = (matches.filter(F.col("outcome") == AMBIGUOUS)
                      .groupBy("workspace").agg(F.count(F.lit(1)).alias("n_waiting")))
    return (lookup(repos, waiting, "workspace").filter(F.col("n_waiting").isNotNull())
                 .select("workspace", "repo_pos", F.substring_index("root_uri", "/", -1).alias("label"),
                         F.col("root_uri").alias("full_path"), "n_waiting"))


def default_repository(workspaces: DataFrame, repos: DataFrame) -> DataFrame:
    """D3: the repository at position 0 of each workspace (NULL when none)."""
    s = workspace_summary(repos)
    return (lookup(workspaces, s, "workspace")
                      .select("workspace", F.col("first_uri").alias("root_uri"),
                              F.coalesce(F.col("n_repos"), F.lit(0)).cast("bigint").alias("n_repos")))


# dispositions of a generate request before any text is sent (A3)
STAGED, AUTO_STAGE, CONFIRM, NOTHING, EMPTY = (
    "staged", "auto_stage", "needs_confirmation", "nothing_to_do", "empty_diff")


def changeset_disposition(df: DataFrame) -> DataFrame:
    """A3: staged changes -> use them; none staged and a clean work tree ->
    nothing to do; none staged with work-tree changes -> stage all when the
    auto-stage preference is on, else ask; an empty diff is skipped."""
    idx, wt = F.col("n_index_changes"), F.col("n_working_changes")
    base = (F.when(idx > 0, F.lit(STAGED))
             .when(wt == 0, F.lit(NOTHING))
             .when(F.col("auto_stage"), F.lit(AUTO_STAGE))
             .otherwise(F.lit(CONFIRM)))
    disp = F.when(base.isin(STAGED, AUTO_STAGE) & (F.length(F.coalesce(F.col("diff"), F.lit(""))) == 0),
                  F.lit(EMPTY)).otherwise(base)
    return (df.withColumn("disposition", disp)
              .withColumn("eligible", F.col("disposition").isin(STAGED, AUTO_STAGE)))
