"""Model-answer and error operators (G1-G6, C4) on a table of responses.

The remote call itself is out of scope: the job ends at a prompt table and
resumes here from a response table. Every operator is row-local except the
retry plan, which joins each retry request to its catalogue's best model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hunkline.operators.lookup import lookup
from hunkline.functions import js_or, js_trim, strip_one_quote

# Error markers and statuses of the reference, in its precedence order.
# (class, message substrings, statuses)
ERROR_RULES = (
    ("invalid_key", ("API_KEY_INVALID",), (400,)),
    ("permission_denied", ("PERMISSION_DENIED",), (403,)),
    ("rate_limited", ("RESOURCE_EXHAUSTED", "quota"), (429,)),
    ("model_not_found", ("MODEL_NOT_FOUND",), (404,)),
    ("invalid_argument", ("INVALID_ARGUMENT",), (400,)),
    ("connection", ("fetch", "network", "ECONNREFUSED"), ()),
)
OTHER = "other"
RETRY_CLASS = "model_not_found"
# ``String(error)`` of an Error whose message is empty
ERROR_STRING = "Error"
DEFAULT_DETAILS = {"en": "One of the request's settings was not accepted.",
                   "es": "Algún ajuste de la petición no fue aceptado."}

# User texts per class and language (our own wording).
ERROR_TEXT = {
    "en": {
        "invalid_key": "The service does not accept the key of this workspace ({msg}). Enter another one.",
        "permission_denied": "The key of this workspace may not call {model} ({msg}).",
        "rate_limited": "Too much was asked of the service for now ({msg}). Wait a while, or use another key.",
        "model_not_found": "Neither {model} nor its replacement answered. Pick a model from the catalogue.",
        "invalid_argument": "The service refused the request ({msg}). {details}",
        "connection": "Connection error: the service could not be reached ({msg}).",
        "other": "The service answered with an error.\nMessage: {msg}\n{status_line}{details_line}",
    },
    "es": {
        "invalid_key": "El servicio no acepta la clave de este espacio ({msg}). Introduce otra.",
        "permission_denied": "La clave de este espacio no puede llamar a {model} ({msg}).",
        "rate_limited": "Por ahora se ha pedido demasiado al servicio ({msg}). Espera un rato o usa otra clave.",
        "model_not_found": "No respondieron ni {model} ni su sustituto. Elige un modelo del catálogo.",
        "invalid_argument": "El servicio rechazó la petición ({msg}). {details}",
        "connection": "Error de conexión: no se pudo llegar al servicio ({msg}).",
        "other": "El servicio respondió con un error.\nMensaje: {msg}\n{status_line}{details_line}",
    },
}
STATUS_LINE = {"en": "Status: {status}\n", "es": "Estado: {status}\n"}
DETAILS_LINE = {"en": "Details: {details}", "es": "Detalles: {details}"}


def clean_text(raw) -> Column:
    """G1: JavaScript trim, then at most one quote off each end (no second trim)."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return strip_one_quote(js_trim(c))


def clean_responses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """G1 + C4: cleaned message; an empty message counts as a failure."""
    return (df.withColumn("message", clean_text(text_col))
              .withColumn("has_message", F.coalesce(F.length("message") > 0, F.lit(False))))


def normalise_errors(df: DataFrame) -> DataFrame:
    """``message || String(error)``, ``status || response.status``,
    ``response.error.message || details`` (empty and 0 fall through)."""
    return (df.withColumn("error_text", js_or("error_message", F.lit(ERROR_STRING)))
              .withColumn("error_status", F.coalesce(F.nullif(F.col("status"), F.lit(0)),
                                                     F.col("response_status")))
              .withColumn("error_details", js_or("response_error_message", F.col("details"))))


def error_class(msg: Column, status: Column) -> Column:
    """First matching rule wins (a 400 never reaches ``invalid_argument``)."""
    out = None
    for name, markers, statuses in ERROR_RULES:
        cond = reduce(lambda a, b: a | b, [msg.contains(m) for m in markers] +
                      [F.coalesce(status == s, F.lit(False)) for s in statuses])
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(OTHER))


SLOTS = ("msg", "model", "status_line", "details_line", "details")


def _printf(template: str) -> str:
    """``{slot}`` template -> ``format_string`` pattern with positional ``%n$s``."""
    out = template.replace("%", "%%")
    for i, slot in enumerate(SLOTS, start=1):
        out = out.replace("{" + slot + "}", f"%{i}$s")
    return out


def _format(pattern: Column, *args: Column) -> Column:
    """SQL ``format_string`` with a pattern chosen per row."""
    return F.call_function("format_string", pattern, *args)


def _templates(table: dict) -> Column:
    """Literal map ``class|language -> pattern`` (folded to a constant)."""
    kv = []
    for lang, by_class in table.items():
        for cls, tpl in by_class.items():
            kv += [F.lit(f"{cls}|{lang}"), F.lit(_printf(tpl))]
    return F.create_map(*kv)


def error_message_col(cls: Column, language: Column, msg: Column, model: Column, status: Column,
                      details: Column) -> Column:
    """The user text for a class, in the request's language (``es`` or English).

    One constant pattern map and one ``format_string``: values are arguments,
    never patterns, so text in a message cannot act as a placeholder."""
    lang = F.when(language == "es", F.lit("es")).otherwise(F.lit("en"))
    key = F.concat(cls, F.lit("|"), lang)
    status_fmt = F.element_at(F.create_map(*[x for l_, t in STATUS_LINE.items()
                                             for x in (F.lit(l_), F.lit(_printf(t.replace("{status}", "{msg}"))))]),
                              lang)
    details_fmt = F.element_at(F.create_map(*[x for l_, t in DETAILS_LINE.items()
                                              for x in (F.lit(l_), F.lit(_printf(t.replace("{details}", "{msg}"))))]),
                               lang)
    status_line = F.when(F.coalesce(status, F.lit(0)) != 0,
                         _format(status_fmt, status.cast("string"))).otherwise(F.lit(""))
    details_line = F.when(F.length(F.coalesce(details, F.lit(""))) > 0,
                          _format(details_fmt, details)).otherwise(F.lit(""))
    default_details = F.element_at(F.create_map(*[x for l_, t in DEFAULT_DETAILS.items()
                                                  for x in (F.lit(l_), F.lit(t))]), lang)
    return _format(F.element_at(_templates(ERROR_TEXT), key), msg, model, status_line,
                   details_line, js_or(details, default_details))


def classify_errors(df: DataFrame) -> DataFrame:
    """G2 + G3 + G6 for rows of failed responses."""
    n = normalise_errors(df)
    return (n.withColumn("error_class", error_class(F.col("error_text"), F.col("error_status")))
             .withColumn("retry", F.col("error_class") == RETRY_CLASS)
             .withColumn("user_text", error_message_col(
                 F.col("error_class"), F.coalesce(F.col("language"), F.lit("en")), F.col("error_text"),
                 F.col("model"), F.col("error_status"), F.col("error_details"))))


def with_retry_model(errors: DataFrame, best: DataFrame, key: str = "catalog_id") -> DataFrame:
    """A ``model_not_found`` request is retried once with its catalogue's
    best model and the same prompt (``retry_model`` is NULL for other classes).
    ``best`` has one row per catalogue."""
    j = lookup(errors, best.select(key, "best_model"), key)
    return j.withColumn("retry_model", F.when(F.col("retry"), F.coalesce(
        F.col("best_model"), F.lit("gemini-flash-latest")))).drop("best_model")


def retry_plan(errors: DataFrame, best: DataFrame, key: str = "catalog_id", prompts: DataFrame | None = None,
               prompt_key: str = "changeset_id") -> DataFrame:
    """G4 as a table of retry requests. With ``prompts`` (one row per ``prompt_key``,
    which ``errors`` carry too) each request comes with the prompt it failed with,
    rendered again from the same change-set; NULL if that is unknown. Only the
    requests to retry meet the prompts."""
    plan = with_retry_model(errors.filter(F.col("retry")), best, key)
    columns = [F.col("request_id"), F.col("model").alias("failed_model"), F.col("retry_model")]
    if prompts is None:
        return plan.select(*columns)
    return (plan.select(*columns, prompt_key).join(prompts.select(prompt_key, "prompt"), prompt_key, "left")
            .select("request_id", "failed_model", "retry_model", prompt_key, "prompt"))


FAILED_TEXT = "The model returned no message"


def final_outcomes(answers: DataFrame, errors: DataFrame) -> DataFrame:
    """Per request the message or the error, and the model that answered.

    ``answers``: cleaned first-pass answers (``clean_responses``).
    ``errors``: classified errors with ``retry_model`` and the retry's raw
    answer ``retry_text`` (NULL when the retry failed too).
    """
    a = answers.select(
        "request_id",
        F.when(F.col("has_message"), F.lit("message")).otherwise(F.lit("error")).alias("outcome"),
        F.when(~F.col("has_message"), F.lit("empty_response")).alias("error_class"),
        F.when(F.col("has_message"), F.col("model")).alias("model_used"),
        F.when(F.col("has_message"), F.col("message")).otherwise(F.lit(FAILED_TEXT)).alias("final_text"))
    retried = clean_text(F.col("retry_text"))
    ok = F.col("retry") & F.col("retry_text").isNotNull() & (F.length(retried) > 0)
    e = errors.select(
        "request_id",
        F.when(ok, F.lit("message")).otherwise(F.lit("error")).alias("outcome"),
        F.when(~ok, F.col("error_class")).alias("error_class"),
        F.when(ok, F.col("retry_model")).alias("model_used"),
        F.when(ok, retried).otherwise(F.col("user_text")).alias("final_text"))
    return a.unionByName(e)
