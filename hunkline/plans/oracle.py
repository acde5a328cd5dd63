"""DuckDB oracle SQL, one string per registered query.

The oracle derives expected answers from the base rows (documents, lineitem,
orders, ...) directly; it never parses the generated diff text, so a parser
bug cannot hide behind the same bug in the oracle. Only the fixture diff text
itself (needed for token counts and pass-through content) is rebuilt here with
``string_agg ... ORDER BY``.
"""

from __future__ import annotations

import re

NL = "chr(10)"

# --- what the prompts, notices and error texts must say, stated here once more: a text
# that changes in an operator alone is a mismatch

RULES = """
You write commit messages in the Conventional Commits 1.0.0 format.

Read the code changes themselves, not only the file names, and say what they do.

## Message layout
<type>[optional scope]: <subject>

<one or two sentences on what changed>

- <main change>
- <further change>

## Types
- feat: a new capability
- fix: a bug fix
- docs: documentation only
- style: formatting without behaviour change
- refactor: restructuring without behaviour change
- perf: faster or leaner code
- test: tests added or changed
- chore: upkeep
- build: build tooling or dependencies
- ci: continuous integration

## Form
Phrase the subject as an instruction in lower case; keep it shorter than 72 characters and
leave out the closing period. Two sentences are enough for the body, whose lines break
at 72 characters. Each bullet states one change that the diff shows.
"""

LANGUAGE_LINE = {
    "en": "\n\nIMPORTANT: Write the commit message in ENGLISH.",
    "es": "\n\nIMPORTANT: Write the commit message in SPANISH.",
}

LARGE_NOTE = ("\n\n## Large Commit Context\n"
              "The diff was too long to send whole ({files} files, {changes} total changes), so what "
              "follows is a COMPACT SUMMARY of it.")

ASK = "\n\nWrite a CONCISE conventional commit message for this git diff:\n\n```diff\n"
FENCE_END = "\n```\n"

GUIDANCE_LARGE = ("\n\nA reader of the history wants two things from this message: the MAIN PURPOSE, in the "
                  "subject, and the HIGH-LEVEL impact, in at most three bullets. Single edits do not matter here.")

GUIDANCE_SMALL = ("\n\nFirst work out WHAT functions/components/features differ before and after, and the "
                  "RELATIONSHIPS that make one edit need another. Then say it for someone who has not seen the diff.")

CLOSING = "\n\nAnswer with the bare text of the message and nothing around it."

# user notices (H8)
LARGE_NOTICE = "{files} files with {changes} changes: too much for one prompt, so a summary of them is sent."
OVER_BUDGET_NOTICE = "Prompt size is {tokens} tokens; the limit set for this repository is {limit}."

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

# fixture errors
ERROR_MESSAGES = ("API_KEY_INVALID: the key was rejected", "PERMISSION_DENIED: caller lacks access",
                  "RESOURCE_EXHAUSTED: too many requests", "daily quota exceeded",
                  "MODEL_NOT_FOUND: no such model", "INVALID_ARGUMENT: bad generation config",
                  "network error: ECONNREFUSED", "")
ERROR_STATUSES = (400, 403, 429, 404, 500, 0, None)

# JavaScript trim's whitespace set, as an RE2 class (same fixed values as jsstr.JS_SPACE)
_NOT_JS_SPACE = (r"[^\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")


def utf16_len(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def est_tokens(x: str) -> str:
    return f"CAST((2 * {utf16_len(x)} + 4) // 5 AS BIGINT)"


def plural(n: str, word: str) -> str:
    return f"CAST({n} AS VARCHAR) || ' {word}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


# F_DOCS, computed from documents without parsing -------------------------------------------
def docs_cte(by_source_only: bool = False) -> str:
    repo = "source" if by_source_only else "lang || '/' || source"
    return _DOC_LINES.replace("__REPO__", repo)


_DOC_LINES = f"""
d0 AS (
  SELECT doc_id, text, lang, source,
         __REPO__ AS repo,
         __REPO__ || '#' || CAST(doc_id // 1000 AS VARCHAR) AS changeset_id,
         lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
         CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed'
              ELSE 'modified' END AS kind,
         doc_id % 17 = 0 AS is_binary,
         string_split(text, {NL}) AS lines
  FROM documents),
d1 AS (
  SELECT *, CASE WHEN kind = 'renamed' THEN 'old/' || path ELSE path END AS old_path,
         CASE WHEN kind = 'new' THEN 1 ELSE doc_id % 5 + 1 END AS new_start,
         len(lines) AS n_lines,
         CASE WHEN doc_id % 4 IN (0, 1) THEN 1 WHEN doc_id % 4 = 2 THEN 3 ELSE 0 END AS mode_n,
         row_number() OVER (PARTITION BY __REPO__ || '#' || CAST(doc_id // 1000 AS VARCHAR)
                            ORDER BY doc_id) AS file_no
  FROM d0),
ln0 AS (
  SELECT doc_id, kind, is_binary, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS i FROM d1),
ln AS (
  SELECT *, CASE kind WHEN 'new' THEN '+' WHEN 'deleted' THEN '-' WHEN 'renamed' THEN ' '
                 ELSE CASE i % 3 WHEN 0 THEN ' ' WHEN 1 THEN '+' ELSE '-' END END AS mark
  FROM ln0),
lc AS (
  SELECT *,
         NOT is_binary AND mark = '+' AND NOT starts_with(t, '++') AS is_add,
         NOT is_binary AND mark = '-' AND NOT starts_with(t, '--') AS is_del
  FROM ln),
lm AS (
  SELECT *, (is_add OR is_del) AND regexp_matches(t, '{_NOT_JS_SPACE}') AS is_meaningful FROM lc),
lk AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM lm WHERE is_meaningful),
dk20 AS (
  SELECT doc_id, string_agg(CASE WHEN is_add THEN '+' ELSE '-' END || ' ' || t || {NL}, '' ORDER BY i)
           AS shown20
  FROM lk WHERE r <= 20 GROUP BY doc_id),
dl AS (
  SELECT doc_id,
         string_agg(mark || t, {NL} ORDER BY i) || {NL} AS body,
         CAST(count(*) FILTER (WHERE is_add) AS BIGINT) AS additions,
         CAST(count(*) FILTER (WHERE is_del) AS BIGINT) AS deletions,
         CAST(count(*) FILTER (WHERE is_add OR is_del OR (NOT is_binary AND mark = ' ')) AS BIGINT)
           AS n_changes,
         CAST(count(*) FILTER (WHERE is_meaningful) AS BIGINT) AS n_meaningful,
         CAST(count(*) FILTER (WHERE NOT is_binary AND mark = ' ') AS BIGINT) AS n_context
  FROM lm GROUP BY doc_id),
dk AS (
  SELECT doc_id, string_agg(CASE WHEN is_add THEN '+' ELSE '-' END || ' ' || t || {NL}, '' ORDER BY i)
           AS shown15
  FROM lk WHERE r <= 15 GROUP BY doc_id),
docs AS (
  SELECT d1.doc_id, d1.repo, d1.changeset_id, d1.file_no, d1.file_no - 1 AS file_pos, d1.mode_n,
         d1.new_start, d1.path, d1.kind, d1.is_binary, d1.old_path,
         dl.additions, dl.deletions, dl.n_changes, dl.n_meaningful, dl.n_context,
         kind = 'new' AS is_new, kind = 'deleted' AS is_deleted, kind = 'renamed' AS is_renamed,
         CASE WHEN kind = 'renamed' THEN old_path END AS parsed_old_path,
         'diff --git a/' || old_path || ' b/' || path || {NL}
         || CASE kind WHEN 'new' THEN 'new file mode 100644' || {NL}
                      WHEN 'deleted' THEN 'deleted file mode 100644' || {NL}
                      WHEN 'renamed' THEN 'similarity index 90%' || {NL} || 'rename from ' || old_path
                                          || {NL} || 'rename to ' || path || {NL}
                      ELSE '' END
         || 'index 0000000..1111111' || {NL}
         || CASE WHEN is_binary THEN 'Binary files a/' || old_path || ' and b/' || path || ' differ' || {NL}
                 ELSE '--- ' || CASE WHEN kind = 'new' THEN '/dev/null' ELSE 'a/' || old_path END || {NL}
                      || '+++ ' || CASE WHEN kind = 'deleted' THEN '/dev/null' ELSE 'b/' || path END || {NL}
                      || '@@ -' || CASE WHEN kind = 'new' THEN '0,0' ELSE '1,' || CAST(n_lines AS VARCHAR) END
                      || ' +' || CASE WHEN kind = 'deleted' THEN '0,0'
                                      ELSE CAST(new_start AS VARCHAR) || ',' || CAST(n_lines AS VARCHAR) END
                      || ' @@' || {NL} || dl.body END AS section,
         '### ' || path || {NL}
         || CASE kind WHEN 'new' THEN '**Status**: New file' || {NL}
                      WHEN 'deleted' THEN '**Status**: Deleted' || {NL}
                      WHEN 'renamed' THEN '**Status**: Renamed from `' || old_path || '`' || {NL}
                      ELSE '' END
         || CASE WHEN is_binary THEN '**Type**: Binary file' || {NL} || {NL}
                 ELSE '**Changes**: +' || CAST(dl.additions AS VARCHAR) || ' -' || CAST(dl.deletions AS VARCHAR)
                      || {NL} || {NL}
                      || CASE WHEN dl.n_meaningful > 0 THEN '**Key changes**:' || {NL} || '```' || {NL}
                              || dk.shown15
                              || CASE WHEN dl.n_meaningful > 15 THEN '... and '
                                      || CAST(dl.n_meaningful - 15 AS VARCHAR) || ' more changes' || {NL}
                                      ELSE '' END
                              || '```' || {NL} || {NL}
                              ELSE '' END END AS block15,
         '### ' || path || {NL}
         || CASE kind WHEN 'new' THEN '**Status**: New file' || {NL}
                      WHEN 'deleted' THEN '**Status**: Deleted' || {NL}
                      WHEN 'renamed' THEN '**Status**: Renamed from `' || old_path || '`' || {NL}
                      ELSE '' END
         || CASE WHEN is_binary THEN '**Type**: Binary file' || {NL} || {NL}
                 ELSE '**Changes**: +' || CAST(dl.additions AS VARCHAR) || ' -' || CAST(dl.deletions AS VARCHAR)
                      || {NL} || {NL}
                      || CASE WHEN dl.n_meaningful > 0 THEN '**Key changes**:' || {NL} || '```' || {NL}
                              || dk20.shown20
                              || CASE WHEN dl.n_meaningful > 20 THEN '... and '
                                      || CAST(dl.n_meaningful - 20 AS VARCHAR) || ' more changes' || {NL}
                                      ELSE '' END
                              || '```' || {NL} || {NL}
                              ELSE '' END END AS block20
  FROM d1 JOIN dl USING (doc_id) LEFT JOIN dk USING (doc_id) LEFT JOIN dk20 USING (doc_id)),
cs AS (
  SELECT repo, changeset_id,
         string_agg(section, '' ORDER BY doc_id) AS diff,
         string_agg(block15, '' ORDER BY doc_id) AS blocks15,
         string_agg(block20, '' ORDER BY doc_id) AS blocks20,
         CAST(count(*) AS BIGINT) AS total_files,
         CAST(sum(additions) AS BIGINT) AS total_additions,
         CAST(sum(deletions) AS BIGINT) AS total_deletions
  FROM docs GROUP BY repo, changeset_id),
cst AS (
  SELECT *, total_additions + total_deletions AS total_changes,
         {est_tokens('diff')} AS estimated_tokens
  FROM cs),
csr AS (
  SELECT *, (total_files > 50 OR total_changes > 500 OR estimated_tokens > 15000) AS was_compacted,
         {plural('total_files', 'file')} || ' changed, '
         || {plural('total_additions', 'insertion')} || '(+), '
         || {plural('total_deletions', 'deletion')} || '(-)' AS stats_line
  FROM cst),
css AS (
  SELECT *, '## Diff Summary' || {NL} || {NL} || '**Statistics**: ' || stats_line || {NL} || {NL} AS head
  FROM csr)
"""


SETTINGS_CTE = r"""
rp AS (
  SELECT DISTINCT lang, source, lang || '/' || source AS repo,
         CAST(regexp_extract(source, '(\d+)', 1) AS INT) AS n
  FROM documents),
st AS (
  SELECT repo,
         CASE WHEN n % 8 = 5 THEN 'fr' WHEN lang = 'es' THEN 'es' WHEN n % 2 = 0 THEN 'en' END AS language,
         CASE WHEN n % 2 = 0 THEN 'gemini-2.5-flash' END AS model,
         CAST(CASE WHEN n % 10 = 7 THEN 500 WHEN n % 3 = 0 THEN 1000 WHEN n % 3 = 1 THEN 20000 END AS BIGINT)
           AS token_limit
  FROM rp WHERE n % 4 <> 3),
rs AS (
  SELECT rp.repo, coalesce(st.language, 'en') AS language,
         coalesce(st.model, 'gemini-flash-latest') AS model,
         CAST(coalesce(st.token_limit, 20000) AS BIGINT) AS token_limit
  FROM rp LEFT JOIN st USING (repo)),
rsb AS (
  SELECT *, language IN ('en', 'es') AND token_limit BETWEEN 1000 AND 1000000 AS in_bounds FROM rs)
"""


def lit(text: str) -> str:
    """A DuckDB string literal (backslashes are literal; quotes doubled)."""
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **cols: str) -> str:
    """Template with ``{name}`` slots -> SQL concatenation."""
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append(lit(template[pos:m.start()]))
        out.append(f"CAST({cols[m.group(1)]} AS VARCHAR)")
        pos = m.end()
    out.append(lit(template[pos:]))
    return " || ".join(out)


PROMPT_SQL = (f"{lit(RULES)} || CASE WHEN language = 'es' THEN {lit(LANGUAGE_LINE['es'])} "
              f"ELSE {lit(LANGUAGE_LINE['en'])} END || CASE WHEN was_compacted THEN "
              f"{fill(LARGE_NOTE, files='total_files', changes='total_changes')} ELSE '' END || "
              f"{lit(ASK)} || content || {lit(FENCE_END)} || CASE WHEN was_compacted THEN "
              f"{lit(GUIDANCE_LARGE)} ELSE {lit(GUIDANCE_SMALL)} END || {lit(CLOSING)}")

PROMPTS_CTE = f"""
pc AS (
  SELECT css.*, rsb.language, rsb.token_limit,
         CASE WHEN was_compacted THEN head || blocks15 ELSE diff END AS content
  FROM css LEFT JOIN rsb USING (repo)),
pr AS (SELECT *, {PROMPT_SQL} AS prompt FROM pc),
pt AS (SELECT *, {est_tokens('prompt')} AS prompt_tokens FROM pr)
"""


def with_docs(select: str, by_source_only: bool = False, extra: str = "") -> str:
    ctes = docs_cte(by_source_only).strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return "WITH " + ctes + "\n" + select


ELIGIBLE_CTE = """
WITH cat AS (
  SELECT p_brand AS catalog_id,
         'models/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS raw_name,
         CASE WHEN (p_partkey // 3) % 3 = 0 THEN NULL WHEN (p_partkey // 3) % 3 = 1 THEN ''
              ELSE p_brand END AS raw_display,
         p_type AS description,
         p_partkey % 3 = 2 AS has_capability
  FROM part),
el AS (
  SELECT catalog_id, regexp_replace(raw_name, 'models/', '') AS name,
         coalesce(nullif(raw_display, ''), raw_name) AS display_name, description
  FROM cat
  WHERE has_capability
    AND NOT (contains(lower(raw_name), 'small') OR contains(lower(raw_name), 'hot-'))
    AND (contains(lower(raw_name), 'ring') OR contains(lower(raw_name), 'widget')
         OR contains(lower(raw_name), 'gear')))"""


BEST_CTE = """,
pri AS (
  SELECT CAST((50 - p_size) AS BIGINT) * 1000000000000 + p_partkey AS priority_rank,
         replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS name
  FROM part WHERE p_size >= 48),
j AS (
  SELECT el.catalog_id, el.name, pri.priority_rank,
         row_number() OVER (PARTITION BY el.catalog_id
                            ORDER BY coalesce(pri.priority_rank, 4611686018427387904), el.name) AS r
  FROM el LEFT JOIN pri USING (name)),
pick AS (
  SELECT catalog_id, max(name) FILTER (WHERE r = 1) AS picked, min(priority_rank) AS best_rank,
         count(*) AS n_eligible
  FROM j GROUP BY catalog_id),
cats AS (SELECT DISTINCT p_brand AS catalog_id FROM part),
best AS (
  SELECT cats.catalog_id, coalesce(picked, 'gemini-flash-latest') AS best_model,
         CASE WHEN best_rank IS NOT NULL THEN 'priority' WHEN picked IS NOT NULL THEN 'first'
              ELSE 'fallback' END AS source,
         CAST(coalesce(n_eligible, 0) AS BIGINT) AS n_eligible
  FROM cats LEFT JOIN pick USING (catalog_id))"""

_JS_SPACE_RE2 = _NOT_JS_SPACE.replace("[^", "[")
def clean_sql(x: str) -> str:
    """JavaScript trim, then at most one quote off each end."""
    return ("regexp_replace(regexp_replace(" + x + ", '\\A" + _JS_SPACE_RE2 + "+|" + _JS_SPACE_RE2
            + "+\\z', '', 'g'), '\\A[\"'']|[\"'']\\z', '', 'g')")

ANSWERS_CTE = f"""
WITH a0 AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id,
         'gemini-flash-latest' AS model,
         CASE WHEN conv_id % 11 = 0 THEN ' "" '
              WHEN conv_id % 4 = 0 THEN '  ' || {NL} || text || ' ' || {NL}
              WHEN conv_id % 4 = 1 THEN '"' || text || '"'
              WHEN conv_id % 4 = 2 THEN chr(39) || text
              ELSE text END AS raw
  FROM conversations WHERE role = 'assistant'),
ans AS (
  SELECT request_id, model, {clean_sql('raw')} AS message FROM a0),
ans2 AS (SELECT 1)"""
ANSWERS_CTE = ANSWERS_CTE.replace("""ans AS (
  SELECT request_id, model, """ + clean_sql('raw') + """ AS message FROM a0),
ans2 AS (SELECT 1)""", """a1 AS (
  SELECT request_id, model, """ + clean_sql('raw') + """ AS message FROM a0),
ans AS (SELECT *, length(message) > 0 AS has_message FROM a1)""")


# The oracle's own statement of the rules, in order: class, message parts, statuses.
CLASSES = (
    ("invalid_key", ["API_KEY_INVALID"], [400]),
    ("permission_denied", ["PERMISSION_DENIED"], [403]),
    ("rate_limited", ["RESOURCE_EXHAUSTED", "quota"], [429]),
    ("model_not_found", ["MODEL_NOT_FOUND"], [404]),
    ("invalid_argument", ["INVALID_ARGUMENT"], [400]),
    ("connection", ["fetch", "network", "ECONNREFUSED"], []),
)
OTHER = "other"


def _error_classes_sql() -> str:
    whens = []
    for name, markers, statuses in CLASSES:
        conds = [f"contains(error_text, {lit(m)})" for m in markers] + [
            f"coalesce(error_status = {st}, false)" for st in statuses]
        whens.append(f"WHEN {' OR '.join(conds)} THEN {lit(name)}")
    return "CASE " + " ".join(whens) + f" ELSE {lit(OTHER)} END"


def _user_text_sql() -> str:
    whens = []
    for lang in ("es", "en"):
        for name in [r[0] for r in CLASSES] + [OTHER]:
            cond = f"error_class = {lit(name)}" + (" AND language = 'es'" if lang == "es" else "")
            tpl = ERROR_TEXT[lang][name]
            if name == OTHER:
                status_line = (f"CASE WHEN coalesce(error_status, 0) <> 0 THEN "
                               f"{fill(STATUS_LINE[lang], status='error_status')} ELSE '' END")
                details_line = (f"CASE WHEN length(coalesce(error_details, '')) > 0 THEN "
                                f"{fill(DETAILS_LINE[lang], details='error_details')} ELSE '' END")
                t = fill(tpl, msg="error_text", status_line=status_line, details_line=details_line)
            elif name == "invalid_argument":
                t = fill(tpl, msg="error_text",
                         details=f"coalesce(nullif(error_details, ''), {lit(DEFAULT_DETAILS[lang])})")
            else:
                t = fill(tpl, msg="error_text", model="model")
            whens.append(f"WHEN {cond} THEN {t}")
    return "CASE " + "\n".join(whens) + " END"


def _errors_cte() -> str:
    msgs = "[" + ", ".join(lit(m) for m in ERROR_MESSAGES) + "]"
    sts = "[" + ", ".join("NULL" if x is None else str(x) for x in ERROR_STATUSES) + "]"
    return f"""
WITH e0 AS (
  SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
e1 AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id,
         CASE WHEN k % 2 = 0 THEN 'gemini-flash-latest' ELSE 'gemini-2.5-flash' END AS model,
         {msgs}[(k // 7) % 8 + 1] AS error_message,
         CAST({sts}[k % 7 + 1] AS INT) AS status,
         CAST(CASE WHEN k % 5 = 0 THEN 404 WHEN k % 5 = 1 THEN 429 END AS INT) AS response_status,
         CASE WHEN event_type IN ('error', 'view') THEN 'upstream: ' || event_type END AS response_error_message,
         CASE WHEN event_type = 'click' THEN 'retry later' WHEN event_type = 'signup' THEN '' END AS details,
         CASE WHEN user_id % 5 = 0 THEN 'es' ELSE 'en' END AS language,
         'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS catalog_id,
         CASE WHEN k % 2 = 0 THEN ' "' || CASE
           WHEN event_id % 16 = 0 AND event_id // 1000 % 3 = 0 THEN 'feat: handle request ' || CAST(event_id AS VARCHAR)
           WHEN event_id % 16 = 1 AND event_id // 1000 % 3 = 0 THEN 'feat(api)!: replace the handling of request ' || CAST(event_id AS VARCHAR)
           WHEN event_id % 16 = 2 AND event_id // 1000 % 3 = 1 THEN 'fix(core): answer request ' || CAST(event_id AS VARCHAR)
           WHEN event_id % 16 = 3 THEN 'docs: Describe request ' || CAST(event_id AS VARCHAR)
           WHEN event_id % 16 = 4 THEN 'refactor(core): reorder the steps of request ' || CAST(event_id AS VARCHAR) || '.'
           WHEN event_id % 16 = 5 THEN 'style: ' || repeat('wide ', 14) || CAST(event_id AS VARCHAR)
           WHEN event_id % 16 = 6 THEN 'perf: speed up request ' || CAST(event_id AS VARCHAR) || {NL} || {NL} || repeat('long ', 16) || 'line'
           WHEN event_id % 16 = 7 THEN 'chore: clean up request ' || CAST(event_id AS VARCHAR) || {NL} || {NL} || 'Short body.' || {NL} || '- one point'
           WHEN event_id % 16 = 8 THEN 'feature: a type of its own for request ' || CAST(event_id AS VARCHAR)
           WHEN event_id % 16 = 9 THEN 'request ' || CAST(event_id AS VARCHAR) || ' without a type'
           WHEN event_id % 16 = 10 THEN 'revert!: undo request ' || CAST(event_id AS VARCHAR)
           WHEN event_id // 1000 % 3 = 2 THEN 'test: cover request ' || CAST(event_id AS VARCHAR)
           ELSE 'fix: regenerated answer for request ' || CAST(event_id AS VARCHAR) END || '" ' END AS retry_text
  FROM e0),
e2 AS (
  SELECT *, coalesce(nullif(error_message, ''), 'Error') AS error_text,
         coalesce(nullif(status, 0), response_status) AS error_status,
         coalesce(nullif(response_error_message, ''), details) AS error_details
  FROM e1),
e3 AS (SELECT *, {_error_classes_sql()} AS error_class FROM e2),
err AS (SELECT *, error_class = 'model_not_found' AS retry, {_user_text_sql()} AS user_text FROM e3)"""


REPOS_CTE = """
WITH repos AS (
  SELECT 'ws' || CAST(s_nationkey AS VARCHAR) AS workspace, s_suppkey AS repo_pos,
         'file:///ws' || CAST(s_nationkey AS VARCHAR) || '/' || s_name AS root_uri
  FROM supplier),
ws AS (
  SELECT workspace, count(*) AS n_repos, arg_min(root_uri, repo_pos) AS first_uri,
         min(repo_pos) AS first_pos, arg_max(root_uri, repo_pos) AS last_uri
  FROM repos GROUP BY workspace),
rq AS (
  SELECT c_custkey AS request_id, 'ws' || CAST(c_nationkey AS VARCHAR) AS workspace,
         CASE c_custkey % 4 WHEN 1 THEN ws.first_uri WHEN 2 THEN ws.last_uri
                            WHEN 3 THEN ws.first_uri || '/' END AS requested_uri
  FROM customer LEFT JOIN ws ON ws.workspace = 'ws' || CAST(c_nationkey AS VARCHAR)),
fm AS (SELECT workspace, root_uri AS requested_uri, min(repo_pos) AS match_pos FROM repos GROUP BY 1, 2),
m AS (
  SELECT rq.*, fm.match_pos, coalesce(ws.n_repos, 0) AS n, ws.first_uri, ws.first_pos
  FROM rq LEFT JOIN fm USING (workspace, requested_uri) LEFT JOIN ws USING (workspace)),
mo AS (
  SELECT *, CASE WHEN n = 0 THEN 'none' WHEN match_pos IS NOT NULL THEN 'matched'
                 WHEN n = 1 THEN 'single_fallback' ELSE 'ambiguous' END AS outcome
  FROM m)"""


def with_settings(select: str) -> str:
    return "WITH " + SETTINGS_CTE.strip() + "\n" + select


# The oracle's own statement of the subject rules.
COMMIT_TYPES = ("feat", "fix", "docs", "style", "refactor", "perf", "test", "chore", "build", "ci", "revert")
SUBJECT_RE = r"^(\w+)(?:\(([^)]*)\))?(!)?: (.+)$"

ERRORS_CTE = _errors_cte()

FINAL_CTE = ELIGIBLE_CTE + BEST_CTE + "," + ERRORS_CTE[len("WITH "):] + "," + ANSWERS_CTE[len("WITH "):] + f"""
, er AS (
  SELECT err.*, CASE WHEN retry THEN coalesce(best.best_model, 'gemini-flash-latest') END AS retry_model,
         {clean_sql('retry_text')} AS retried
  FROM err LEFT JOIN best USING (catalog_id)),
eo AS (SELECT *, retry AND retry_text IS NOT NULL AND length(retried) > 0 AS ok FROM er),
fo AS (
  SELECT request_id, CASE WHEN has_message THEN 'message' ELSE 'error' END AS outcome,
         CASE WHEN NOT has_message THEN 'empty_response' END AS error_class,
         CASE WHEN has_message THEN model END AS model_used,
         CASE WHEN has_message THEN message ELSE 'The model returned no message' END AS final_text
  FROM ans
  UNION ALL
  SELECT request_id, CASE WHEN ok THEN 'message' ELSE 'error' END AS outcome,
         CASE WHEN NOT ok THEN error_class END AS error_class,
         CASE WHEN ok THEN retry_model END AS model_used,
         CASE WHEN ok THEN retried ELSE user_text END AS final_text
  FROM eo),
fm AS (
  SELECT request_id, final_text AS message,
         CASE WHEN starts_with(request_id, 'c')
              THEN 'conv-' || CAST(CAST(regexp_extract(request_id, '^[ce](\\d+)', 1) AS BIGINT) // 10 AS VARCHAR)
              ELSE 'events-' || CAST(CAST(regexp_extract(request_id, '^[ce](\\d+)', 1) AS BIGINT) // 1000 AS VARCHAR)
         END AS release
  FROM fo WHERE outcome = 'message'),
ps AS (
  SELECT *, CASE WHEN contains(message, {NL}) THEN substr(message, strpos(message, {NL}) + 1) ELSE '' END AS body,
         split_part(message, {NL}, 1) AS subject
  FROM fm),
ps2 AS (SELECT *, regexp_matches(subject, '{SUBJECT_RE}') AS hit FROM ps),
pj AS (
  SELECT *, CASE WHEN hit THEN regexp_extract(subject, '{SUBJECT_RE}', 1) END AS commit_type,
         CASE WHEN hit THEN nullif(regexp_extract(subject, '{SUBJECT_RE}', 2), '') END AS scope,
         CASE WHEN hit THEN regexp_extract(subject, '{SUBJECT_RE}', 3) = '!' END AS breaking,
         CASE WHEN hit THEN regexp_extract(subject, '{SUBJECT_RE}', 4) END AS description
  FROM ps2)"""

ORACLE: dict[str, str] = {
    "process_diffs": with_docs("""
SELECT changeset_id, total_files, total_additions, total_deletions, total_changes,
       estimated_tokens, was_compacted,
       md5(CASE WHEN was_compacted THEN head || blocks15 ELSE diff END) AS content_md5
FROM css"""),
    "file_sections": with_docs(f"""
SELECT changeset_id, CAST(file_pos AS INT) AS file_pos, md5(substr(section, 12)) AS section_md5,
       CAST({utf16_len('substr(section, 12)')} AS BIGINT) AS section_units
FROM docs"""),
    "section_lines": with_docs("""
SELECT changeset_id, CAST(file_pos AS INT) AS file_pos,
       CAST(generate_subscripts(sl, 1) - 1 AS INT) AS line_pos, unnest(sl) AS line
FROM (SELECT changeset_id, file_pos, string_split(substr(section, 12), chr(10)) AS sl FROM docs)"""),
    "parsed_files": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, CAST(file_pos AS INT) AS file_pos, path,
       parsed_old_path AS old_path, is_binary, is_new, is_deleted, is_renamed,
       additions, deletions, n_changes
FROM docs"""),
    "file_headers": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, path, parsed_old_path AS old_path, is_renamed
FROM docs"""),
    "file_flags": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, is_new, is_deleted, is_binary, is_renamed
FROM docs"""),
    "file_counts": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, additions, deletions FROM docs"""),
    "file_status": with_docs(f"""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, kind AS status,
       CASE kind WHEN 'new' THEN '**Status**: New file' || {NL}
                 WHEN 'deleted' THEN '**Status**: Deleted' || {NL}
                 WHEN 'renamed' THEN '**Status**: Renamed from `' || old_path || '`' || {NL}
                 ELSE '' END AS status_line
FROM docs"""),
    "hunks": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, CAST(1 AS BIGINT) AS hunk_no,
       CAST(mode_n + 4 AS INT) AS header_pos,
       CAST(CASE WHEN kind = 'deleted' THEN 0 ELSE new_start END AS BIGINT) AS new_start,
       additions, deletions, n_context AS context
FROM docs WHERE NOT is_binary"""),
    "line_changes": with_docs("""
SELECT d.changeset_id, CAST(d.file_no AS INT) AS file_no, CAST(d.mode_n + 5 + l.i AS INT) AS line_pos,
       CASE WHEN l.is_add THEN 'addition' WHEN l.is_del THEN 'deletion' ELSE 'context' END AS change_type,
       l.t AS line
FROM lm l JOIN docs d USING (doc_id)
WHERE l.is_add OR l.is_del OR (NOT l.is_binary AND l.mark = ' ')"""),
    "change_line_numbers": with_docs("""
SELECT d.changeset_id, CAST(d.file_no AS INT) AS file_no,
       CAST(row_number() OVER (PARTITION BY l.doc_id ORDER BY l.i) - 1 AS INT) AS k,
       CASE WHEN l.is_add THEN 'addition' WHEN l.is_del THEN 'deletion' ELSE 'context' END AS change_type, l.t AS line,
       CASE WHEN NOT l.is_del THEN CAST((CASE WHEN d.kind = 'deleted' THEN 0 ELSE d.new_start END)
         + count(*) FILTER (WHERE NOT l.is_del) OVER (PARTITION BY l.doc_id ORDER BY l.i) - 1 AS BIGINT) END AS line_number
FROM lm l JOIN docs d USING (doc_id)
WHERE l.is_add OR l.is_del OR (NOT l.is_binary AND l.mark = ' ')"""),
    "line_numbers": with_docs("""
SELECT d.changeset_id, CAST(d.file_no AS INT) AS file_no, CAST(d.mode_n + 5 + l.i AS INT) AS line_pos,
       CASE WHEN l.is_add THEN 'addition' ELSE 'context' END AS change_type,
       CAST(d.new_start + row_number() OVER (PARTITION BY l.doc_id ORDER BY l.i) - 1 AS BIGINT)
         AS line_number
FROM lm l JOIN docs d USING (doc_id)
WHERE l.is_add OR (NOT l.is_binary AND l.mark = ' ')"""),
    "diff_stats": """
WITH f AS (
  SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS INT) AS qty, min(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (
  SELECT l_orderkey, greatest(qty, 1) AS n,
         CASE flag WHEN 'A' THEN 'new' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS kind
  FROM f),
h AS (
  SELECT l_orderkey,
         CASE kind WHEN 'new' THEN n WHEN 'deleted' THEN 0 ELSE (n + 1) // 3 END AS a,
         CASE kind WHEN 'deleted' THEN n WHEN 'new' THEN 0 ELSE n // 3 END AS d
  FROM g),
k AS (SELECT l_orderkey, count(*) AS nf, sum(a) AS sa, sum(d) AS sd FROM h GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS changeset_id,
       CAST(coalesce(nf, 0) AS BIGINT) AS total_files,
       CAST(coalesce(sa, 0) AS BIGINT) AS total_additions,
       CAST(coalesce(sd, 0) AS BIGINT) AS total_deletions,
       CAST(coalesce(sa, 0) + coalesce(sd, 0) AS BIGINT) AS total_changes
FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""",
    "estimate_tokens": f"""
SELECT doc_id, CAST({utf16_len('text')} AS BIGINT) AS utf16_units, {est_tokens('text')} AS estimated_tokens
FROM documents""",
    "is_large": with_docs("""
SELECT changeset_id, total_files, total_changes, estimated_tokens,
       total_files > 50 AS large_by_files, total_changes > 500 AS large_by_changes,
       estimated_tokens > 15000 AS large_by_tokens, was_compacted AS is_large
FROM csr""", by_source_only=True),
    "meaningful_changes": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, n_meaningful FROM docs"""),
    "top_changes": with_docs("""
SELECT d.changeset_id, CAST(d.file_no AS INT) AS file_no, CAST(k.r AS INT) AS k,
       CASE WHEN k.is_add THEN 'addition' ELSE 'deletion' END AS change_type, k.t AS line,
       CAST(greatest(d.n_meaningful - 15, 0) AS BIGINT) AS n_more
FROM lk k JOIN docs d USING (doc_id) WHERE k.r <= 15"""),
    "summary_stats_line": with_docs("""
SELECT changeset_id, stats_line FROM csr"""),
    "file_blocks": with_docs("""
SELECT changeset_id, CAST(file_no AS INT) AS file_no, md5(block20) AS block_md5 FROM docs"""),
    "compact_summary": with_docs(f"""
SELECT changeset_id, md5(head || blocks20) AS summary_md5,
       CAST({utf16_len('(head || blocks20)')} AS BIGINT) AS summary_units
FROM css"""),
    "resolve_settings": with_settings("""
SELECT repo, language, model, token_limit, in_bounds FROM rsb"""),
    "build_prompts": with_docs(f"""
SELECT changeset_id, language, was_compacted, md5(prompt) AS prompt_md5,
       CAST({utf16_len('prompt')} AS BIGINT) AS prompt_units
FROM pr""", extra=SETTINGS_CTE + "," + PROMPTS_CTE),
    "token_gate": with_docs(f"""
, ex AS (
  SELECT lang || '/' || source || '#' || CAST(doc_id // 1000 AS VARCHAR) AS changeset_id,
         CAST(sum(length(text)) // 5 AS BIGINT) AS exact_tokens
  FROM documents WHERE CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 2 = 0 GROUP BY 1),
pe AS (SELECT pt.* EXCLUDE (prompt_tokens), exact_tokens, coalesce(exact_tokens, prompt_tokens) AS prompt_tokens FROM pt LEFT JOIN ex USING (changeset_id))
SELECT changeset_id, exact_tokens, prompt_tokens, token_limit,
       CASE WHEN prompt_tokens > token_limit THEN 'over_budget' ELSE 'ok' END AS gate,
       CASE WHEN prompt_tokens > token_limit THEN
         {fill(OVER_BUDGET_NOTICE, tokens="format('{:,}', prompt_tokens)", limit="format('{:,}', token_limit)")}
       END AS notice,
       CASE WHEN was_compacted THEN {fill(LARGE_NOTICE, files='total_files', changes='total_changes')}
       END AS large_notice
FROM pe""", extra=SETTINGS_CTE + "," + PROMPTS_CTE),
    "model_rejects": """
SELECT DISTINCT p_brand AS catalog_id, p_partkey // 100 AS page, CAST(1 AS INT) AS attempt,
       CAST(CASE WHEN p_partkey // 100 % 4 = 2 THEN 500 ELSE 200 END AS INT) AS status,
       CASE p_partkey // 100 % 4 WHEN 1 THEN 'malformed' WHEN 2 THEN 'http_status' ELSE 'unnamed_model' END AS reason
FROM part WHERE p_partkey // 100 % 4 > 0""",
    "model_eligible": ELIGIBLE_CTE + """
SELECT catalog_id, name, display_name, description FROM el""",
    "model_order": ELIGIBLE_CTE + """
SELECT catalog_id, name, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY name) AS INT) AS pos
FROM el""",
    "model_current": ELIGIBLE_CTE + """,
cur AS (
  SELECT p_brand AS catalog_id, arg_max(replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR), p_partkey)
           AS current_model
  FROM part GROUP BY p_brand)
SELECT el.catalog_id, el.name, coalesce(el.name = cur.current_model, false) AS is_current
FROM el LEFT JOIN cur USING (catalog_id)""",
    "best_model": ELIGIBLE_CTE + BEST_CTE + """
SELECT catalog_id, best_model, source, n_eligible FROM best""",
    "clean_responses": ANSWERS_CTE + """
SELECT request_id, message, has_message FROM ans""",
    "classify_errors": ERRORS_CTE + """
SELECT request_id, error_class, error_status, retry, user_text FROM err""",
    "retry_plan": with_docs(f"""
, tg AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id, lang || '/' || source || '#' || CAST(doc_id // 1000 AS VARCHAR) AS changeset_id
  FROM events LEFT JOIN documents ON doc_id = event_id // 9)
SELECT request_id, model AS failed_model, coalesce(best.best_model, 'gemini-flash-latest') AS retry_model, changeset_id,
       md5(prompt) AS prompt_md5, CAST({utf16_len('prompt')} AS BIGINT) AS prompt_units
FROM err LEFT JOIN best USING (catalog_id) LEFT JOIN tg USING (request_id) LEFT JOIN pr USING (changeset_id)
WHERE retry""", extra=SETTINGS_CTE + "," + PROMPTS_CTE + "," + (ELIGIBLE_CTE + BEST_CTE).strip()[len("WITH "):] + "," + ERRORS_CTE.strip()[len("WITH "):]),
    "final_outcomes": FINAL_CTE + "\nSELECT request_id, outcome, error_class, model_used, final_text FROM fo",
    "match_repository": REPOS_CTE + """
SELECT request_id, workspace, requested_uri, CAST(n AS BIGINT) AS n_repos, outcome,
       CASE outcome WHEN 'matched' THEN requested_uri WHEN 'single_fallback' THEN first_uri END AS matched_uri,
       CASE outcome WHEN 'matched' THEN match_pos WHEN 'single_fallback' THEN first_pos END AS matched_pos
FROM mo""",
    "repo_candidates": REPOS_CTE + """,
wt AS (SELECT workspace, count(*) AS n_waiting FROM mo WHERE outcome = 'ambiguous' GROUP BY workspace)
SELECT r.workspace, r.repo_pos, string_split(r.root_uri, '/')[-1] AS label, r.root_uri AS full_path,
       wt.n_waiting
FROM repos r JOIN wt USING (workspace)""",
    "default_repository": REPOS_CTE + """
SELECT 'ws' || CAST(n_nationkey AS VARCHAR) AS workspace, ws.first_uri AS root_uri,
       CAST(coalesce(ws.n_repos, 0) AS BIGINT) AS n_repos
FROM nation LEFT JOIN ws ON ws.workspace = 'ws' || CAST(n_nationkey AS VARCHAR)""",
    "eligible_changesets": """
WITH f AS (
  SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_linestatus = 'O') AS n_open,
         count(*) FILTER (WHERE l_linestatus = 'F') AS n_final
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
k AS (SELECT l_orderkey, sum(n_open) AS n_open, sum(n_final) AS n_final, count(*) AS nf FROM f GROUP BY l_orderkey),
o AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS changeset_id,
         CAST(coalesce(n_open, 0) AS INT) AS n_index_changes,
         CAST(coalesce(n_final, 0) AS INT) AS n_working_changes,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS auto_stage, coalesce(nf, 0) AS nf
  FROM orders LEFT JOIN k ON o_orderkey = l_orderkey),
b AS (
  SELECT *, CASE WHEN n_index_changes > 0 THEN 'staged' WHEN n_working_changes = 0 THEN 'nothing_to_do'
                 WHEN auto_stage THEN 'auto_stage' ELSE 'needs_confirmation' END AS base
  FROM o),
d AS (SELECT *, CASE WHEN base IN ('staged', 'auto_stage') AND nf = 0 THEN 'empty_diff' ELSE base END
             AS disposition FROM b)
SELECT changeset_id, n_index_changes, n_working_changes, auto_stage, disposition,
       disposition IN ('staged', 'auto_stage') AS eligible
FROM d""",
    "repo_rollup": with_docs("""
SELECT repo, CAST(count(*) AS BIGINT) AS n_changesets, CAST(sum(total_files) AS BIGINT) AS total_files,
       CAST(sum(total_additions) AS BIGINT) AS total_additions,
       CAST(sum(total_deletions) AS BIGINT) AS total_deletions,
       CAST(sum(total_changes) AS BIGINT) AS total_changes,
       CAST(count(*) FILTER (WHERE was_compacted) AS BIGINT) AS n_large
FROM csr GROUP BY repo"""),
    "next_version": r"""
WITH p AS (
  SELECT 'pkg-' || CAST(p_partkey AS VARCHAR) AS package,
         regexp_extract(p_brand, '(\d+)', 1) || '.' || CAST(p_size AS VARCHAR) || '.'
           || CAST(p_partkey % 100 AS VARCHAR) AS version,
         ['major', 'minor', 'patch'][p_partkey % 3 + 1] AS bump,
         CASE WHEN p_partkey % 7 = 0 THEN '9.9.' || CAST(p_partkey AS VARCHAR) END AS explicit_version
  FROM part),
v AS (
  SELECT *, TRY_CAST(string_split(version, '.')[1] AS INT) AS maj,
         TRY_CAST(string_split(version, '.')[2] AS INT) AS mnr,
         TRY_CAST(string_split(version, '.')[3] AS INT) AS pat,
         len(string_split(version, '.')) AS np
  FROM p)
SELECT package, version, bump, explicit_version,
       CASE WHEN length(coalesce(explicit_version, '')) > 0 THEN explicit_version
            WHEN np >= 3 AND maj IS NOT NULL AND mnr IS NOT NULL AND pat IS NOT NULL THEN
              CASE coalesce(nullif(bump, ''), 'patch')
                WHEN 'major' THEN CAST(maj + 1 AS VARCHAR) || '.0.0'
                WHEN 'minor' THEN CAST(maj AS VARCHAR) || '.' || CAST(mnr + 1 AS VARCHAR) || '.0'
                ELSE CAST(maj AS VARCHAR) || '.' || CAST(mnr AS VARCHAR) || '.' || CAST(pat + 1 AS VARCHAR) END
       END AS next_version
FROM v""",
    "parse_subject": FINAL_CTE + """
SELECT request_id, commit_type, scope, breaking, description FROM pj""",
    "subject_conformance": FINAL_CTE + f"""
, cf AS (
  SELECT request_id, coalesce(commit_type IN ({", ".join(lit(t) for t in COMMIT_TYPES)}), false) AS type_ok,
         length(subject) < 72 AS length_ok,
         coalesce(substr(description, 1, 1) = lower(substr(description, 1, 1)), false) AS lowercase_ok,
         NOT ends_with(subject, '.') AS no_period_ok,
         len(list_filter(string_split(body, {NL}), lambda l: length(l) > 72)) = 0 AS wrapped_ok
  FROM pj)
SELECT *, type_ok AND length_ok AND lowercase_ok AND no_period_ok AND wrapped_ok AS conforms FROM cf""",
    "release_bump": FINAL_CTE + """
SELECT release, CAST(count(*) AS BIGINT) AS n_commits,
       CASE WHEN count(*) FILTER (WHERE commit_type = 'feat') > 0 THEN 'minor'
            WHEN count(*) FILTER (WHERE commit_type = 'fix') > 0 THEN 'patch' ELSE 'none' END AS bump
FROM pj GROUP BY release""",
    "stream_process": with_docs("""
SELECT changeset_id, total_files, total_additions, total_deletions, total_changes,
       estimated_tokens, was_compacted,
       md5(CASE WHEN was_compacted THEN head || blocks15 ELSE diff END) AS content_md5
FROM css"""),
    "dedupe_requests": with_docs("""
, rq AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id, event_id, ts,
         lang || '/' || source || '#' || CAST(doc_id // 1000 AS VARCHAR) AS changeset_id
  FROM events LEFT JOIN documents ON doc_id = event_id // 9),
rk AS (
  SELECT rq.*, cs.repo, sha256(cs.diff) AS diff_sha FROM rq LEFT JOIN cs USING (changeset_id))
SELECT repo, diff_sha, strftime(time_bucket(INTERVAL '10 minutes', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       first(request_id ORDER BY ts, request_id) AS kept_request, count(*) AS n_requests,
       count(*) - 1 AS n_suppressed
FROM rk GROUP BY repo, diff_sha, CASE WHEN repo IS NULL OR diff_sha IS NULL THEN request_id END,
  time_bucket(INTERVAL '10 minutes', ts)"""),
    "stream_dedupe": with_docs("""
, rq AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id, event_id, ts,
         lang || '/' || source || '#' || CAST(doc_id // 1000 AS VARCHAR) AS changeset_id
  FROM events LEFT JOIN documents ON doc_id = event_id // 9),
ra AS (
  SELECT request_id, event_id, ts, cs.repo, sha256(cs.diff) AS diff_sha,
         date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 15 + CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS arrival
  FROM rq LEFT JOIN cs USING (changeset_id)),
r1 AS (
  SELECT *, CASE WHEN repo IS NULL OR diff_sha IS NULL THEN request_id ELSE repo || chr(0) || diff_sha END AS key,
  FROM ra QUALIFY row_number() OVER (PARTITION BY arrival, repo, diff_sha, CASE WHEN repo IS NULL OR diff_sha IS NULL THEN request_id END
                                     ORDER BY ts, event_id) = 1),
wm AS (SELECT arrival, max(max(ts)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS w
       FROM r1 GROUP BY arrival),
r2 AS (SELECT r1.*, wm.w, coalesce(ts <= w, false) AS late, row_number() OVER (PARTITION BY key ORDER BY r1.arrival) AS k
       FROM r1 JOIN wm USING (arrival)),
st AS (
  SELECT key, k, NOT late AS kept, CASE WHEN NOT late THEN ts + INTERVAL 2 DAY END AS expires FROM r2 WHERE k = 1
  UNION ALL
  SELECT r2.key, r2.k, NOT late AND NOT coalesce(expires > w, false),
         CASE WHEN NOT late AND NOT coalesce(expires > w, false) THEN ts + INTERVAL 2 DAY ELSE expires END
  FROM st JOIN r2 ON r2.key = st.key AND r2.k = st.k + 1)
SELECT request_id, repo, diff_sha, strftime(ts, '%Y-%m-%d %H:%M:%S') AS requested_at
FROM r2 JOIN st USING (key, k) WHERE kept""").replace("WITH d0", "WITH RECURSIVE d0", 1),
    "scan_diff_files": with_docs(f"""
SELECT changeset_id, total_files, total_additions, total_deletions,
       CAST({utf16_len('diff')} AS BIGINT) AS diff_units
FROM css"""),
    "release_versions": FINAL_CTE + """
, rb AS (
  SELECT split_part(release, '-', 1) AS package, CAST(split_part(release, '-', 2) AS BIGINT) AS ordinal,
         CASE WHEN count(*) FILTER (WHERE commit_type = 'feat') > 0 THEN 'minor'
              WHEN count(*) FILTER (WHERE commit_type = 'fix') > 0 THEN 'patch' ELSE 'none' END AS bump
  FROM pj GROUP BY release),
rm AS (SELECT *, count(*) FILTER (WHERE bump = 'minor') OVER (PARTITION BY package ORDER BY ordinal) AS minors FROM rb),
rv AS (SELECT *, count(*) FILTER (WHERE bump = 'patch') OVER (PARTITION BY package, minors ORDER BY ordinal) AS patches FROM rm)
SELECT package, ordinal, bump, '1.' || CAST(4 + minors AS VARCHAR) || '.'
       || CAST(CASE WHEN minors = 0 THEN 2 ELSE 0 END + patches AS VARCHAR) AS version
FROM rv""",
    "message_sink": FINAL_CTE + """
, tg AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS request_id, 1 AS pass, event_id AS n, 0 AS turn, lang, source, doc_id
  FROM events LEFT JOIN documents ON doc_id = event_id // 9
  UNION ALL
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 0, conv_id, turn, lang, source, doc_id
  FROM conversations LEFT JOIN documents ON doc_id = conv_id * 11 WHERE role = 'assistant'),
tr AS (SELECT request_id, pass, n, turn, lang || '/' || source AS repo,
              lang || '/' || source || '#' || CAST(doc_id // 1000 AS VARCHAR) AS changeset_id FROM tg),
bx AS (
  SELECT fo.* EXCLUDE (outcome), repo, changeset_id,
         CASE WHEN repo IS NULL THEN 'no_repository' WHEN outcome = 'message' AND length(coalesce(final_text, '')) > 0 THEN 'message'
              ELSE 'rejected' END AS outcome,
         row_number() OVER (PARTITION BY repo, changeset_id, CASE WHEN repo IS NULL THEN request_id END
                            ORDER BY pass DESC, n DESC, turn DESC) AS r
  FROM fo JOIN tr USING (request_id))
SELECT repo, changeset_id, request_id, outcome, error_class, model_used, CASE WHEN outcome = 'message' THEN final_text END AS message
FROM bx WHERE r = 1""",
    "model_catalog_json": """
SELECT p_brand AS catalog_id, 'models/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS name,
       CASE WHEN (p_partkey // 3) % 3 = 0 THEN NULL WHEN (p_partkey // 3) % 3 = 1 THEN '' ELSE p_brand END
         AS display_name,
       p_type AS description,
       CAST(CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS n_methods
FROM part""",
    "process_diffs_by_file": with_docs("""
SELECT changeset_id, total_files, total_additions, total_deletions, total_changes,
       estimated_tokens, was_compacted,
       md5(CASE WHEN was_compacted THEN head || blocks15 ELSE diff END) AS content_md5
FROM css"""),
    "is_large_parts": f"""
WITH f AS (
  SELECT l_partkey, l_orderkey, greatest(CAST(sum(l_quantity) AS INT), 1) AS n
  FROM lineitem GROUP BY l_partkey, l_orderkey),
s AS (
  SELECT CAST(l_partkey AS VARCHAR) || '#' || CAST(l_orderkey // 65536 AS VARCHAR) AS changeset_id,
         l_orderkey, n,
         'part/' || CAST(l_partkey AS VARCHAR) || '/' || CAST(l_orderkey AS VARCHAR) || '.txt' AS p
  FROM f),
sec AS (
  SELECT changeset_id, l_orderkey, n,
         'diff --git a/' || p || ' b/' || p || {NL} || 'new file mode 100644' || {NL}
         || 'index 0000000..1111111' || {NL} || '--- /dev/null' || {NL} || '+++ b/' || p || {NL}
         || '@@ -0,0 +1,' || CAST(n AS VARCHAR) || ' @@' || {NL} || repeat('+unit' || {NL}, n) AS section
  FROM s),
c AS (
  SELECT changeset_id, CAST(count(*) AS BIGINT) AS total_files, CAST(sum(n) AS BIGINT) AS total_changes,
         string_agg(section, '' ORDER BY l_orderkey) AS diff
  FROM sec GROUP BY changeset_id),
t AS (SELECT *, {est_tokens('diff')} AS estimated_tokens FROM c)
SELECT changeset_id, total_files, total_changes, estimated_tokens,
       total_files > 50 AS large_by_files, total_changes > 500 AS large_by_changes,
       estimated_tokens > 15000 AS large_by_tokens,
       (total_files > 50 OR total_changes > 500 OR estimated_tokens > 15000) AS is_large
FROM t""",
    "line_numbers_blocked": None,
}
ORACLE["line_numbers_blocked"] = ORACLE["line_numbers"]
ORACLE["scan_diff_lines"] = ORACLE["scan_diff_files"]
