"""Model-catalogue operators (I1-I6, F3, F4) on a table of models.

A catalogue row is ``(catalog_id, name, display_name, description, methods)``;
``catalog_id`` separates independent catalogues (one per account, say), so
every operator here is per catalogue and scales with the number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.functions import js_or, js_replace_first
from hunkline.operators.lookup import lookup
from hunkline.operators.rank import position_within

# The reference's catalogue filters, priority list and fallback model.
CAPABILITY = "generateContent"
EXCLUDE_TOKENS = ("embedding", "imagen", "veo", "-tts", "-image-", "native-audio", "robotics",
                  "computer-use", "aqa")
INCLUDE_TOKENS = ("gemini", "gemma")
PRIORITY = (
    "gemini-flash-latest", "gemini-flash-lite-latest", "gemini-pro-latest",
    "gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.5-pro",
    "gemini-2.0-flash-001", "gemini-2.0-flash", "gemini-2.0-flash-lite-001", "gemini-2.0-flash-lite",
    "gemini-2.0-flash-exp", "gemini-exp-1206",
    "gemini-3-pro-preview",
    "gemma-3-27b-it", "gemma-3-12b-it", "gemma-3-4b-it", "gemma-3-1b-it",
)
FALLBACK_MODEL = "gemini-flash-latest"
NAME_PREFIX = "models/"
LOCALE = "UNICODE"


def _any_contains(text: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens], F.lit(False))


MODEL = "STRUCT<name: STRING, displayName: STRING, description: STRING, supportedGenerationMethods: ARRAY<STRING>>"

# why a model-list response is turned down
FAILED, MALFORMED, UNNAMED = "http_status", "malformed", "unnamed_model"


def _no_list(models: Column) -> Column:
    """A ``models`` value that counts as no list: missing, null, false, 0 or ''."""
    text = F.col("_list_text")
    return models.isNull() | F.is_variant_null(models) | text.isin("false", "0", "")


def read_responses(df: DataFrame, json_col: str = "body", status_col: str | None = None,
                   capability: str = CAPABILITY) -> DataFrame:
    """A5: ``df`` with ``models`` (parsed list) and ``reject`` (NULL for a good
    response). The reference fails the whole listing if the answer is not a success,
    if the body is no JSON or the JSON ``null``, if ``models`` is something else than
    a list, or if a model it would have to look at has no name; here such a
    response is turned down whole, and the others are not affected. Any other JSON
    without a list of models is an empty catalogue. Row-local; each body is parsed once."""
    status = F.col(status_col) if status_col else F.lit(None).cast("int")
    failed = status.isNotNull() & ~status.between(200, 299)
    whole = df.withColumn("_json", F.when(~failed, F.try_parse_json(json_col)))
    listed = whole.withColumn("_list", F.try_variant_get("_json", "$.models", "variant"))
    listed = (listed.withColumn("_list_text", F.try_variant_get("_list", "$", "string"))
              .withColumn("_array", F.schema_of_variant("_list").startswith("ARRAY")))
    empty = _no_list(F.col("_list"))
    typed = listed.withColumn("models", F.when(F.col("_array"), F.try_variant_get("_list", "$", f"ARRAY<{MODEL}>")))
    nameless = F.exists("models", lambda m: m.isNull() | (F.coalesce(F.array_contains(m["supportedGenerationMethods"], capability), F.lit(False))
                                                          & m["name"].isNull()))
    reject = (F.when(failed, F.lit(FAILED))
              .when(F.col("_json").isNull() | F.is_variant_null("_json"), F.lit(MALFORMED))
              .when(F.col("models").isNull() & ~empty, F.lit(MALFORMED))
              .when(F.coalesce(nameless, F.lit(False)), F.lit(UNNAMED)))
    return typed.withColumn("reject", reject).drop("_json", "_list", "_list_text", "_array")


def models_from_response(df: DataFrame, json_col: str = "body", keys: list[str] | None = None,
                         status_col: str | None = None) -> DataFrame:
    """A5: the models of all good responses, a row each."""
    keys = keys or []
    good = read_responses(df, json_col, status_col).filter(F.col("reject").isNull() & F.col("models").isNotNull())
    return (good.select(*keys, F.inline("models"))
            .select(*keys, "name", F.col("displayName").alias("display_name"), "description",
                    F.col("supportedGenerationMethods").alias("methods")))


def response_rejects(df: DataFrame, json_col: str = "body", keys: list[str] | None = None,
                     status_col: str | None = None) -> DataFrame:
    """A5: the responses that were turned down, with the reason and the body as it came."""
    status = [status_col] if status_col else []
    return (read_responses(df, json_col, status_col).filter(F.col("reject").isNotNull())
            .select(*(keys or []), *status, F.col("reject").alias("reason"), F.col(json_col).alias("body")))


def rejects(catalog: DataFrame) -> DataFrame:
    """Rows of a catalogue table that have no ``name``: routed aside, not fatal."""
    return catalog.filter(F.col("name").isNull())


def eligible_models(catalog: DataFrame, include=INCLUDE_TOKENS, exclude=EXCLUDE_TOKENS,
                    capability: str = CAPABILITY) -> DataFrame:
    """Capability filter, exclude/include tokens on the lower-cased
    name, first ``models/`` removed, display name falling back to the raw name."""
    lname = F.lower(F.col("name"))
    keep = (F.coalesce(F.array_contains(F.col("methods"), capability), F.lit(False))
            & ~_any_contains(lname, exclude) & _any_contains(lname, include))
    return (catalog.filter(F.col("name").isNotNull() & keep)
                   .select(*[c for c in catalog.columns if c not in ("name", "display_name")],
                           js_replace_first(F.col("name"), NAME_PREFIX).alias("name"),
                           js_or(F.col("display_name"), F.col("name")).alias("display_name")))


def locale_key(name) -> Column:
    """``localeCompare`` order."""
    c = F.col(name) if isinstance(name, str) else name
    return F.collate(c, LOCALE)


def model_order(models: DataFrame, group: str = "catalog_id") -> DataFrame:
    """position of each model in its catalogue by locale order of name."""
    return position_within(models, [group], [locale_key("name")])


def mark_current(models: DataFrame, current: DataFrame, group: str = "catalog_id") -> DataFrame:
    """Flag the model equal to the catalogue's configured model (``current_model``)."""
    j = lookup(models, current.select(group, "current_model"), group)
    return j.withColumn("is_current", F.coalesce(F.col("name") == F.col("current_model"), F.lit(False)))


def priority_table(spark: SparkSession, names=PRIORITY) -> DataFrame:
    """The priority list as a (priority_rank, name) table; its size is the list length."""
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)],
                                 "priority_rank BIGINT, name STRING")


def best_model(models: DataFrame, catalogs: DataFrame, priority: DataFrame,
               group: str = "catalog_id") -> DataFrame:
    """Per catalogue, the best-ranked priority name present, else the
    first model in locale order, else (empty catalogue) the fallback constant.
    The models are not shuffled to meet ``priority`` (a measured lookup; the
    built-in list has 17 rows), only their partial aggregates are.
    """
    j = lookup(models, priority, "name")
    big = F.lit(2 ** 62).cast("bigint")
    pick = (j.groupBy(group)
             .agg(F.min_by(F.col("name"), F.struct(F.coalesce(F.col("priority_rank"), big),
                                                   locale_key("name"))).alias("picked"),
                  F.min("priority_rank").alias("best_rank"),
                  F.count(F.lit(1)).alias("n_eligible")))
    out = catalogs.select(group).join(pick, group, "left")
    return out.select(
        group,
        F.coalesce(F.col("picked"), F.lit(FALLBACK_MODEL)).alias("best_model"),
        F.when(F.col("best_rank").isNotNull(), F.lit("priority"))
         .when(F.col("picked").isNotNull(), F.lit("first"))
         .otherwise(F.lit("fallback")).alias("source"),
        F.coalesce(F.col("n_eligible"), F.lit(0)).cast("bigint").alias("n_eligible"))
