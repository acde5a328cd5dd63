"""Registered queries of the training-data operators, and their SQL.

Each query applies its operator, with production parameters, to its whole
table. SQL is given where DuckDB can express the result exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.llm import annsearch, bpe, decontaminate, divergence, kneserney, langid, linededup, manifest, minhash, pages, quality, suffixdedup, toxicity

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the public rank file, and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_predict(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.train_and_score(_table(spark, sf_dir, "documents"))


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), *tokenizer(), tables=2.0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annsearch.Index(_table(spark, sf_dir, "embeddings")).search(F.col("id") % 100 == 0, 10)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.Index(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).digest()


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(_table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_langid, op2_line_dedup, op3_minhash, op4_kneser_ney, op5_page_text, op6_bpe,
                            op7_quality, op8_toxicity, op9_nearest, op10_decontaminate, op11_divergence, op12_suffix_dedup,
                            op13_manifest)}

_OP2 = """
WITH l AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
p AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS c
      FROM l, unnest(range(1, len(ls) + 1)) AS t(i)),
w AS (SELECT doc_id, i, c, lead(c, 1) OVER x AS c2, lead(c, 2) OVER x AS c3, lead(i, 2) OVER x AS i3
      FROM p WHERE c <> '' WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, i3, row_number() OVER (PARTITION BY c, c2, c3 ORDER BY doc_id, i) AS occurrence
      FROM w WHERE c3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, j AS i FROM f, unnest(range(i, i3 + 1)) AS u(j) WHERE occurrence > 1),
left_over AS (SELECT p.doc_id, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
                     string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS text
              FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT l.doc_id, CAST(len(l.ls) AS BIGINT) AS n_lines, coalesce(left_over.n_removed, 0) AS n_removed,
       CASE WHEN l.text IS NOT NULL THEN coalesce(left_over.text, '') END AS text
FROM l LEFT JOIN left_over USING (doc_id)
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
           FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
      FROM benchmark),
q AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM d, (SELECT DISTINCT n FROM q), unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT s.doc_id, s.i, s.n, q.item FROM s JOIN q ON s.n = q.n AND s.phrase = q.phrase),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP11 = rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
           FROM documents),
c AS (SELECT row_id, lang, source, term, count(*) AS n FROM t, unnest(w) AS u(term) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING count(*) >= {divergence.MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS words FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, sum(n) AS n FROM c SEMI JOIN kept USING (lang, term) GROUP BY ALL),
words AS (SELECT lang, source, sum(n) AS words FROM cells GROUP BY ALL),
g AS (SELECT lang, source, coalesce(words, 0) AS words FROM (SELECT DISTINCT lang, source FROM t) LEFT JOIN words USING (lang, source)),
s AS (SELECT g.lang, g.source, kept.term, coalesce(cells.n, 0) AS n,
             1 + CAST({divergence.SCALE} AS HUGEINT) * (coalesce(cells.n, 0) + 1) // (g.words + langs.v) AS p,
             1 + CAST({divergence.SCALE} AS HUGEINT) * (kept.n + 1) // (langs.words + langs.v) AS q
      FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN cells USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM s WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

_FIELDS13 = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
                        for c in manifest.FIELDS)
_OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256({_FIELDS13}) AS leaf, sha256({_FIELDS13.replace("n_chars", "(n_chars + 1)")}) AS bad,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                      lambda c: CAST(ascii(c) AS BIGINT))),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
             CAST(4294967295 AS BIGINT)) % {manifest.TAMPERED} = 0 AS tampered
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT lang, 0 AS level, pos AS i, leaf AS h, n FROM l
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1
  GROUP BY lang, level, i // 2, n),
langs AS (SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
                 count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (
  SELECT 0 AS level, pos AS i, subroot AS h, n FROM langs
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2, n),
root AS (SELECT h AS root, level AS height FROM top WHERE n = 1),
steps AS (
  SELECT l.lang, l.pos, k, (l.pos >> k) & 1 AS side, s.h AS sibling
  FROM l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang, unnest(range(langs.height)) AS t(k)
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = k AND s.i = xor(l.pos >> k, 1)
  UNION ALL
  SELECT l.lang, l.pos, langs.height + k, (langs.pos >> k) & 1, s.h
  FROM l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang, unnest(range((SELECT height FROM root))) AS t(k)
  LEFT JOIN top s ON s.level = k AND s.i = xor(langs.pos >> k, 1)),
proofs AS (SELECT lang, pos, sha256(coalesce(string_agg(sibling, '' ORDER BY k), '')) AS proof, count(*) AS n FROM steps GROUP BY lang, pos),
folds AS (
  SELECT lang, pos, 0 AS k, CASE WHEN tampered THEN bad ELSE leaf END AS h FROM l
  UNION ALL
  SELECT f.lang, f.pos, f.k + 1, CASE WHEN sibling IS NULL THEN sha256(f.h) WHEN side = 1 THEN sha256(sibling || f.h)
                                      ELSE sha256(f.h || sibling) END
  FROM folds f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.k = f.k)
SELECT l.doc_id, l.leaf, langs.subroot, root.root, coalesce(proofs.proof, sha256('')) AS proof_sha256,
       folds.h AS folded_root, folds.h = root.root AS verified
FROM l JOIN langs ON l.lang IS NOT DISTINCT FROM langs.lang JOIN root ON true
LEFT JOIN proofs ON proofs.lang IS NOT DISTINCT FROM l.lang AND proofs.pos = l.pos
JOIN folds ON folds.lang IS NOT DISTINCT FROM l.lang AND folds.pos = l.pos AND folds.k = coalesce(proofs.n, 0)
"""

SQL: dict[str, str] = {"op2_line_dedup": _OP2, "op10_decontaminate": _OP10, "op11_divergence": _OP11, "op13_manifest": _OP13}
