"""Toxicity scoring with subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (three to five bytes of the word
between border marks, hashed into buckets) and of the word as a whole. A word's
vector is the mean of its n-grams' vectors, a text's vector is the mean of its
words' vectors, and a linear softmax over it gives the probability of the label.
Vectors and softmax are trained jointly, in numpy, with Adagrad. Misspellings
and endings never seen share most n-grams with seen words, so they share their
vectors.

Training uses a bounded sample of the labelled rows: the first ``TRAIN_ROWS``
rows of each label in the order of a hash of the id, up to ``TRAIN_BYTES`` bytes
of text of that label. A text longer than ``LONGEST`` of its label's bytes is not
learned from, so the sample cannot be used up by a few. The passes over the sample
follow from a bound on updates (``UPDATES``, ``PASSES``): few labels are seen more
often. N-grams in fewer than ``MIN_TEXTS`` training texts (one for every 500 texts, up to
that number) are not learned. Tasks compute their bags and write them to the shared folder, where the
driver maps them. Scoring covers whole texts of all rows: since the model is linear
behind the averages, a bucket's contribution is one number, and tasks carry a
table of ``BUCKETS`` numbers.

Defined cases: a null text, or one without a word, scores what an empty bag
scores: the softmax of the bias alone. Rows with a null id or label are not
learned from; a null id counts as held out. Without labelled rows of both labels
every score is the share of toxic rows learned from (0 if none). Repeated rows
are rows like others. Columns other than id and text are never read for a score.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm.runtime import arrow_map, fields, remainder, workdir
from hunkline.llm.textscan import _BYTE_VALUES, ALNUM, LOWER, U64, Words, buffers, mix64, steps

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SIZES = (3, 4, 5)
DIMENSIONS = 8
TRAIN_ROWS = (6_000, 2_000)  # at most, with label 0 and with label 1
TRAIN_BYTES = (24 << 20, 8 << 20)
LONGEST = 1 / 32            # share of the bytes that one text may take
MIN_TEXTS = 6               # training texts that a trained bucket occurs in, at most
UPDATES = 48_000            # texts seen in all passes
PASSES = (6, 60)            # at least, at most
RATE = 0.05
SCALE = 50.0                # constant factor on a text's mean vector
DAMPING = 1e-2              # first value of the vectors' Adagrad sums
SEED = 7
_STEP_BYTES = 1 << 18


def _grams(data: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of all n-grams of the words, size by size, then of the words
    themselves."""
    size = words.ends - words.starts
    n = len(words)
    # the words one after another, each behind a border mark, and one mark at the end
    begin = np.cumsum(size + 1) - size - 1
    line = np.full(int(size.sum()) + n + 1, 32, np.uint8)
    inside = np.ones(len(line), bool)
    inside[begin] = inside[-1] = False
    keep = np.zeros(len(data) + 1, np.int32)
    np.add.at(keep, words.starts, 1)
    np.add.at(keep, words.ends, -1)
    line[inside] = data[np.cumsum(keep[:-1]) > 0]
    marks = np.cumsum(~inside)
    values = _BYTE_VALUES[line]
    h = values
    for k in range(2, max(SIZES) + 1):
        h = h[:-1] * U64(0x9FB21C651E98DF25) + values[k - 1:]
        if k in SIZES:
            # no mark strictly between the first and the last byte
            at = np.flatnonzero(marks[k - 2:-1] == marks[:len(h)]) if k > 2 else np.arange(len(h))
            at = at[inside[at] | inside[at + 1]]
            word = marks[at] - 1
            ok = word < n
            yield word[ok], (mix64(h[at[ok]] + U64(k)) >> U64(64 - BUCKET_BITS)).astype(np.int64)
    yield np.arange(n), (words.hashes >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _scanned(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    data, offsets = buffers(column)
    for a, b in steps(offsets, _STEP_BYTES):
        part = LOWER[data[offsets[a]:offsets[b]]]
        yield a, b, part, Words(part, offsets[a:b + 1] - offsets[a], ALNUM)


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: distinct buckets and their weights (a text's weights sum to 1)."""
    for a, b, data, w in _scanned(column):
        if not len(w):
            yield from [(np.zeros(0, np.int64), np.zeros(0))] * (b - a)
            continue
        pairs = list(_grams(data, w))
        word = np.concatenate([p[0] for p in pairs])
        bucket = np.concatenate([p[1] for p in pairs])
        share = 1.0 / np.bincount(word, minlength=len(w))
        doc = w.text_of()
        share /= np.diff(w.first)[doc]
        key = doc[word] << BUCKET_BITS | bucket
        distinct, place = np.unique(key, return_inverse=True)
        weight = np.bincount(place, share[word])
        cuts = np.searchsorted(distinct >> BUCKET_BITS, np.arange(b - a + 1))
        for i in range(b - a):
            yield distinct[cuts[i]:cuts[i + 1]] & (BUCKETS - 1), weight[cuts[i]:cuts[i + 1]]


@dataclass
class Model:
    table: np.ndarray   # a bucket's contribution to the log odds
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for a, b, data, w in _scanned(column):
            mean = np.zeros(b - a)
            if len(w):
                total, count = np.zeros(len(w)), np.zeros(len(w), np.int64)
                for word, bucket in _grams(data, w):
                    total += np.bincount(word, self.table[bucket], len(w))
                    count += np.bincount(word, minlength=len(w))
                sums = np.concatenate(([0.0], np.cumsum(total / count)))
                n = np.diff(w.first)
                mean = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(n, 1)
            out.append(mean)
        odds = np.concatenate(out) + self.bias if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, min_texts: int = MIN_TEXTS, updates: int = UPDATES) -> Model:
    """Joint training of bucket vectors and softmax, text by text."""
    toxic = float(labels.mean()) if len(labels) else 0.0
    if not 0 < toxic < 1:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((toxic + 1e-9) / (1 - toxic + 1e-9))))
    rng = np.random.default_rng(SEED)
    texts = np.zeros(BUCKETS, np.int32)
    for ids, _ in rows:
        texts[ids] += 1  # a bag's buckets are distinct
    used = texts >= min(min_texts, max(1, len(rows) // 500))
    passes = int(np.clip(round(updates / len(rows)), *PASSES))
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    vectors[~used] = 0
    softmax = np.zeros((DIMENSIONS, 2), np.float32)
    softmax[:, 1] = 1 / np.sqrt(DIMENSIONS)
    softmax[:, 0] = -softmax[:, 1]
    bias = np.zeros(2)
    seen_v, seen_s, seen_b = np.full((BUCKETS, DIMENSIONS), DAMPING, np.float32), np.full((DIMENSIONS, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(passes):
        rate = RATE * (1 - epoch / passes)
        for i in rng.permutation(len(rows)):
            ids, w = rows[i]
            ids, w = ids[known := used[ids]], w[known] * np.float32(SCALE)
            own = vectors[ids]
            hidden = w @ own
            z = hidden @ softmax + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # gradient of the logits
            back = (softmax @ p).astype(np.float32)
            g = np.outer(hidden, p)
            seen_s += g * g
            softmax -= (rate * g / np.sqrt(seen_s)).astype(np.float32)
            seen_b += p * p
            bias -= rate * p / np.sqrt(seen_b)
            gv = w[:, None] * back
            total = seen_v[ids] + gv * gv
            seen_v[ids] = total
            vectors[ids] = own - rate * gv / np.sqrt(total)
    direction = softmax[:, 1] - softmax[:, 0]
    return Model((vectors @ direction * SCALE).astype(np.float32), float(bias[1] - bias[0]))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          label: str = "toxic", usable: Column | None = None) -> Model:
    """Fit on the bounded sample; ``usable`` says which label rows may be used."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    if usable is not None:
        marks = marks.filter(usable)
    order = (F.xxhash64("id"), F.col("id"))
    ids = None
    for value in (0, 1):
        part = marks.filter(F.col("label") == value).distinct().orderBy(*order).limit(TRAIN_ROWS[value])
        ids = part if ids is None else ids.unionByName(part)
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most sum(TRAIN_ROWS) ids; repeated ids of the texts count once
    most = F.when(F.col("label") == 0, TRAIN_BYTES[0]).otherwise(TRAIN_BYTES[1])
    sofar = [F.sum(F.when(F.col("label") == value, F.col("size"))).over(Window.orderBy(*order, "label")) for value in (0, 1)]
    sizes = (texts.join(F.broadcast(ids), "id").groupBy("id", "label").agg(F.max(F.octet_length("text")).alias("size"))
             .filter(F.col("size") <= most * LONGEST)
             .withColumn("sofar", F.when(F.col("label") == 0, sofar[0]).otherwise(sofar[1]))
             .filter(F.col("sofar") <= most).select("id", "label"))
    sample = (texts.join(F.broadcast(sizes), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
              .select("text", "label", F.xxhash64("id", "label").alias("place")))
    folder = workdir(df.sparkSession, "bags")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            got, name = list(bags(batch.column(0))), uuid.uuid4().hex
            for part, values in (("ids", [g[0].astype("<u4") for g in got]), ("weights", [g[1].astype("<f4") for g in got])):
                with open(os.path.join(folder, f"{name}.{part}.npy"), "wb") as f:
                    np.save(f, np.concatenate(values))
            size = np.array([len(g[0]) for g in got], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(1), pa.array([name] * len(got), pa.string()),
                 pa.array(np.cumsum(size) - size), pa.array(size)], names=["place", "label", "file", "start", "size"])

    found = arrow_map(sample, task, fields(("place", T.LongType()), ("label", T.IntegerType()), ("file", T.StringType()),
                                           ("start", T.LongType()), ("size", T.LongType()))).collect()
    found.sort(key=lambda r: (r.place, r.label))
    files: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for name in {r.file for r in found}:  # mapped, not read: the bags stay out of the driver's memory
        files[name] = tuple(np.load(os.path.join(folder, f"{name}.{part}.npy"), mmap_mode="r") for part in ("ids", "weights"))
    rows = [(files[r.file][0][r.start:r.start + r.size], files[r.file][1][r.start:r.start + r.size]) for r in found]
    return fit(rows, np.array([r.label for r in found], np.int64))


def with_score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``df`` with the score as one more column (replacing one of that name)."""
    rows = df.drop(column)
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T.DoubleType())])
    names = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.scores(batch.column(names.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=schema.names)

    return arrow_map(rows, task, schema)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as no column needs (names are compared
    without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def learn_and_score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                    label: str = "toxic", folds: int = 5) -> DataFrame:
    """Learn from labelled rows whose id's crc32 modulo ``folds`` is not 0; one row
    per row of ``df``: id, held_out, score, predicted."""
    model = learn(df, labels, id_col, text, label, remainder(F.col("id"), folds) != 0)
    rows = df.select(F.col(id_col), F.coalesce(remainder(F.col(id_col), folds) == 0, F.lit(True)).alias("held_out"),
                     F.col(text).alias("text"))
    return (with_score(rows, model).drop("text")
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))
