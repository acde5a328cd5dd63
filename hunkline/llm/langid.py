"""Language identification with rank-order n-gram profiles.

A profile is a list of n-grams (one to three characters, letters and word
borders) from the most frequent on. The distance of a document to a language is
the sum, over the document's most frequent n-grams, of how far each stands out
of place in the language's profile; an n-gram that the profile lacks counts as
the profile's length. The nearest language is predicted.

Profiles are counted by Spark over all training rows: tasks count the n-grams
of whole texts by language, a shuffle sums them, and the top of each language is
kept. Only the profiles (``PROFILE`` n-grams a language) reach the driver.

Letters are what Unicode calls letters, lower-cased; everything else is a word
border. A text is counted in pieces, so its length does not bound memory.

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text if nothing was learned. Rows with a null language or a null id
are not learned from; a null id counts as held out. On a tie the language that
comes first in the alphabet wins, and n-grams of equal count are ranked by their
code. Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm.runtime import arrow_map, fields, remainder
from hunkline.llm.store import summed

PROFILE = 400        # n-grams of a language's profile
DOCUMENT = 300       # n-grams of a document's profile
UNDETERMINED = "und"
_PIECE = 1 << 19     # characters counted at a time
_HELD = 200_000      # distinct n-grams that a task holds for a language

_BORDER = 1          # code of a word border, never that of a letter
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or ``_BORDER``."""
    if not _LETTERS:
        table = np.full(0x110000, _BORDER, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a run of codes and their counts."""
    c = codes.astype(np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != _BORDER) | (c[:-1] != _BORDER)  # one border between words
    c = c[keep]
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != _BORDER]
    return np.unique(np.concatenate([c[c != _BORDER], two, three]), return_counts=True)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts. A piece ends at a border if
    it has one, and overlaps the next by two characters if not."""
    keys, counts = [], []
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not (codes != _BORDER).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate(([_BORDER], codes, [_BORDER])).astype(np.uint32)
    for at in range(0, len(codes), _PIECE):
        piece = codes[max(at - 2, 0):at + _PIECE]
        k, c = _counted(piece)
        if at:  # what the overlap has counted already
            k0, c0 = _counted(piece[:2])
            c[np.searchsorted(k, k0)] -= c0
        keys.append(k)
        counts.append(c)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = summed(np.concatenate(keys), np.concatenate(counts))
    return k[c > 0], c[c > 0]


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent keys in order of rank (ties: smaller key)."""
    return keys[np.argsort(-counts, kind="stable")[:n]]


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows of ``df`` with a language."""
    rows = df.filter(F.col(lang).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang"))

    def batch_of(lang: str, parts: list) -> pa.RecordBatch:
        k, c = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(c)],
                                          names=["lang", "gram", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hunkline.llm import langid

        held: dict[str, list] = {}
        size_of: dict[str, int] = {}
        for batch in batches:
            for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
                k, c = langid.ngrams(value.as_py())
                held.setdefault(name, []).append((k, c))
                size_of[name] = size_of.get(name, 0) + len(k)
                if size_of[name] > _HELD:
                    parts = held.pop(name)
                    k, c = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    held[name], size_of[name] = [(k, c)], len(k)
                    if len(k) > _HELD // 2:
                        yield batch_of(name, held.pop(name))
                        size_of[name] = 0
        for name, parts in held.items():
            yield batch_of(name, parts)

    counts = (arrow_map(rows, task, fields(("lang", T.StringType()), ("gram", T.LongType()), ("n", T.LongType())))
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # the top of a language is among the tops of slices of its n-grams
    order = (F.col("n").desc(), F.col("gram"))
    part = Window.partitionBy("lang", F.pmod(F.hash("gram"), F.lit(32))).orderBy(*order)
    best = (counts.withColumn("r", F.row_number().over(part)).filter(F.col("r") <= size)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col("rank") <= size).select("lang", "rank", "gram"))
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        out.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {name: [g for _, g in sorted(out[name])] for name in sorted(out)}


class Profiles:
    """Ranks of all profiles' n-grams: one row per n-gram, one column per language."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.names = sorted(profiles)
        self.worst = max((len(p) for p in profiles.values()), default=0)
        self.grams = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()] or [np.zeros(0, np.int64)]))
        # the last row stands for n-grams that no profile has
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), self.worst, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def distances(self, doc: np.ndarray) -> np.ndarray:
        """Out-of-place distances of a document's ranked n-grams to each language."""
        at = np.minimum(np.searchsorted(self.grams, doc), len(self.grams) - 1)
        at = np.where(self.grams[at] == doc, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(doc))[:, None])
        return np.where(ranks == self.worst, self.worst, np.minimum(away, self.worst)).sum(axis=0)

    def predict(self, text: str, size: int = DOCUMENT) -> tuple[str, float]:
        """(language, score); the score is 1 for a distance of 0, and 0 for a
        document that shares no n-gram with the profile."""
        keys, counts = ngrams(text)
        if not len(keys) or not self.names:
            return UNDETERMINED, 0.0
        doc = top(keys, counts, size)
        away = self.distances(doc)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (self.worst * len(doc)))


def predict(df: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text: str = "text",
            held_out: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, held_out, lang_pred, score."""
    model = Profiles(profiles)
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).alias("id"),
                     (F.lit(False) if held_out is None else held_out).alias("held_out"))
    schema = fields((id_col, df.schema[id_col].dataType), ("held_out", T.BooleanType()),
                    ("lang_pred", T.StringType()), ("score", T.DoubleType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return arrow_map(rows, task, schema)


def learn_and_predict(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                      folds: int = 3, test_fold: int = 1) -> DataFrame:
    """Learn from rows whose id's crc32 modulo ``folds`` is not ``test_fold``;
    predict all rows."""
    fold = remainder(F.col(id_col), folds)
    profiles = learn(df.filter(fold != test_fold), text, lang)
    return predict(df, profiles, id_col, text, F.coalesce(fold == test_fold, F.lit(True)))
