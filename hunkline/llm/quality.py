"""Quality scores from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (2) on every text.
Expectation-maximisation over the counts of all vote patterns (at most
3 ** 6 rows, counted by Spark over all documents) estimates each labeller's
accuracies and each pattern's probability of being good. These posterior labels
train a linear scorer over hashed features of a bounded sample (the first
``TRAIN_ROWS`` texts in the order of a hash of text and id, up to ``TRAIN_BYTES``
bytes, without texts that alone take more than ``LONGEST`` of them), and the scorer scores all whole texts. Features are byte trigrams, and how
far the text repeats itself within a few bytes.

Bad texts are bad in different ways, so one class of them rarely fails two tests
at once. Left alone, EM takes the kind that fails several for the only one. So a
good text is held to fail any one test with a probability of ``FALSE_ALARM`` at most;
a kind of bad text that fails a single test and is not far above that share may
still pass for good.

Defined cases: null and empty texts have no trigram and no echo.
Repeated rows and null ids are rows like others. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm.runtime import arrow_map, fields
from hunkline.llm.textscan import U64, buffers, mix64

TRAIN_ROWS = 4_000
TRAIN_BYTES = 16 << 20
LONGEST = 1 / 32
BITS = 16
EPOCHS = 5
RATE = 0.5
FALSE_ALARM = 0.01   # bound on P(vote bad | good), for each labeller
LAGS = 24            # distances at which a text is compared with itself
GOOD, BAD, ABSTAIN = 1, 0, 2


def with_votes(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the column ``votes``: one per labeller, each of which looks at
    another trait and abstains in between. Words and shares are columns of their
    own, so that each is computed once a text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size
    traits = df.select("*", words.alias("_words"), share(r"[^\p{L}\p{N}\s.,]+").alias("_symbols"),
                       share(r"\p{Lu}+").alias("_upper"), share(r"\p{N}+").alias("_digits"))
    some = F.greatest(F.col("_n"), F.lit(1))
    traits = traits.select("*", F.size("_words").alias("_n"), F.size(F.array_distinct("_words")).alias("_different"),
                           F.length(F.array_join("_words", "")).alias("_inked")).drop("_words")
    traits = traits.select("*", (F.col("_different") / some).alias("_distinct"), (F.col("_inked") / some).alias("_mean"))
    n, symbols, upper, digits, distinct, mean = (F.col(c) for c in ("_n", "_symbols", "_upper", "_digits", "_distinct", "_mean"))

    def between(good: Column, bad: Column) -> Column:
        return F.when(n == 0, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    votes = [between(symbols < 0.01, symbols > 0.05), between(upper < 0.1, upper > 0.3),
             between(digits < 0.05, digits > 0.15), between(distinct > 0.4, distinct < 0.2),
             between((mean > 3) & (mean < 9), (mean < 2) | (mean > 15)), between(n >= 30, n < 5)]
    return traits.select(*df.columns, F.array(*votes).alias("votes"))


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, false_alarm: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, P(vote | class) as labeller x class x vote);
    P(vote bad | good) stays within ``false_alarm``."""
    n = patterns.shape[1]
    # to begin with: a good text fails few tests, a bad one still passes many
    table = np.tile(np.array([[0.35, 0.45, 0.2], [0.03, 0.8, 0.17]]), (n, 1, 1))
    prior = 0.8
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, patterns[:, j]] / table[j, 0, patterns[:, j]]) for j in range(n))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for j in range(n):
            for v in range(3):
                table[j, :, v] = weight[:, patterns[:, j] == v].sum(axis=1) + 1
            table[j] /= table[j].sum(axis=1, keepdims=True)
            if (high := table[j, GOOD, BAD]) > false_alarm:
                table[j, GOOD] *= (1 - false_alarm) / (1 - high)
                table[j, GOOD, BAD] = false_alarm
        prior = float(np.clip(weight[1].sum() / max(weight.sum(), 1), 0.01, 0.99))
    return posterior, table


def _echo(d: np.ndarray) -> int:
    """Tenths of the bytes that recur at the same distance, for the best one."""
    return max((int(10 * np.count_nonzero(d[lag:] == d[:-lag]) / len(d)) for lag in range(2, min(LAGS, len(d) - 1) + 1)), default=0)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text's byte trigrams, with weights of norm 1, and
    one bucket of weight 1 for its echo."""
    data, offsets = buffers(column)
    for a, b in zip(offsets[:-1], offsets[1:]):
        d = data[a:b].astype(U64)
        keys = mix64(d[:-2] << U64(16) | d[1:-1] << U64(8) | d[2:]) >> U64(64 - BITS) if len(d) > 2 else np.zeros(0, U64)
        ids, n = np.unique(keys.astype(np.int64), return_counts=True)
        w = np.sqrt(n)
        echo = (1 << BITS) + _echo(data[a:b])
        yield np.append(ids, echo), np.append(w / max(float(np.sqrt((w * w).sum())), 1e-9), 1.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels, text by text, with Adagrad."""
    size = (1 << BITS) + 11  # trigrams and echoes
    weights, seen, bias, rng = np.zeros(size), np.full(size, 1e-2), 0.0, np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, w = rows[i]
            g = 1 / (1 + np.exp(-np.clip(weights[ids] @ w + bias, -50, 50))) - target[i]
            seen[ids] += (g * w) ** 2
            weights[ids] -= RATE * g * w / np.sqrt(seen[ids])
            bias -= 0.05 * g
    return weights, bias


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, score (0 to 1, higher: better), predicted."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).alias("id"))
    found = with_votes(rows).groupBy("votes").count().collect()
    patterns = np.array([r.votes for r in found], np.int64).reshape(-1, 6)
    posterior, _ = em(patterns, np.array([r["count"] for r in found], float), false_alarm=FALSE_ALARM)
    label = {tuple(r.votes): float(p) for r, p in zip(found, posterior)}
    # keys choose the sample, so that only the sample's texts are moved
    keyed = rows.select("text", "id", F.xxhash64("text", F.col("id").cast("string")).alias("place"),
                        F.octet_length("text").alias("size")).filter(F.col("size") <= TRAIN_BYTES * LONGEST)

    def first(df: DataFrame) -> DataFrame:
        chosen = df.orderBy("place", "id").limit(TRAIN_ROWS)
        return (chosen.withColumn("sofar", F.sum("size").over(Window.orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)))
                .filter(F.col("sofar") <= TRAIN_BYTES).drop("sofar"))

    last = first(keyed.select("place", "id", "size")).agg(F.max("place")).first()[0]
    sample = with_votes(first(keyed.filter(F.col("place") <= F.lit(last)))).orderBy("place", "id").select("text", "votes").toArrow()
    column = sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string())
    weights, bias = fit(list(features(column)), np.array([label[tuple(v)] for v in sample.column("votes").to_pylist()]))
    schema = fields((id_col, df.schema[id_col].dataType), ("score", T.DoubleType()), ("predicted", T.IntegerType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array([weights[ids] @ w + bias for ids, w in features(batch.column(0))])
            s = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return arrow_map(rows, task, schema)
