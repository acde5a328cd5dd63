"""From raw documents to training tokens: the operators of ``hunkline.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns the documents it lets pass,
with the columns of ``documents``; the last returns the encoded texts. Stages are
written as Parquet and read again, so each works on all its predecessor kept.

Every decision is one about a row: ids may be null or shared. Defined cases: a null
text is not toxic unless empty texts are, has no lines, is linked with nothing and
has no token. Rows of equal text are one group of near duplicates, of which the row
with the smallest id stays (a null id comes last); a contaminated text goes with all
its rows. Other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkline.llm import bpe, decontaminate, linededup, minhash, toxicity
from hunkline.llm.queries import tokenizer
from hunkline.llm.runtime import remainder, stored
from hunkline.operators.lookup import lookup

REJECT = 0.5  # toxicity score from which a document goes


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below ``REJECT`` pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, usable=remainder(F.col("id"), 5) != 0)
    columns = docs.columns
    score = toxicity.free_name("score", columns)
    return toxicity.with_score(docs, model, column=score).filter(F.col(score) < REJECT).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated line windows go. A document that had text and has nothing but blanks
    and line ends left is a whole copy of earlier lines, and goes too."""
    n_lines, n_removed = (toxicity.free_name(c, docs.columns) for c in ("n_lines", "n_removed"))
    out = linededup.dedup_lines(docs, n_lines=n_lines, n_removed=n_removed)
    lost = (F.col(n_removed) > 0) & (F.btrim("text", F.lit(linededup.BLANK + "\n")) == "")
    kept = out.filter(~F.coalesce(lost, F.lit(False)))
    return kept.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates passes. Rows are numbered in a
    stored table, so the operator decides about rows, not ids."""
    row = toxicity.free_name("row_number", docs.columns)
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(rows.select(row, "text"), id_col=row)
    members = rows.select(F.col(row).alias("r"), F.col("doc_id").alias("i")).join(found.select(F.col(row).alias("r"), "component_id"), "r")
    stays = (members.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull().alias("n"), "i", "r")).alias("m"), F.count("*").alias("n"))
             .filter(F.col("n") > 1).select("component_id", F.col("m.r").alias("stays")))
    gone = lookup(members, stays, "component_id").filter(F.col("r") != F.col("stays")).select(F.col("r").alias(row))
    return _without(rows, gone, row).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a window of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = toxicity.free_name("text_sha256", docs.columns)
    keyed = docs.withColumn(key, F.sha2("text", 256))
    found = decontaminate.Index(keyed.select(key, "text"), benchmark, id_col=key).digest()
    return _without(keyed, found.filter("contaminated").select(key).distinct(), key).select(*docs.columns)


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``gone``; a measured lookup, so texts are not
    shuffled while the list is short."""
    mark = toxicity.free_name("gone", docs.columns)
    return lookup(docs, gone.withColumn(mark, F.lit(True)), key).filter(F.col(mark).isNull())


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as tokens, with digests of the ids and of the decoded text."""
    # Python workers outlive a stage: small tables leave the next ones room
    return bpe.encode(docs, *tokenizer(), with_ids=True, tables=0.3)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", encoding),
]

#: Toxicity scores and byte-level BPE cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
