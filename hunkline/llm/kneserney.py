"""Interpolated modified Kneser-Ney language model.

Counted in Spark, kept as sorted hash arrays in the shared folder, scored by
tasks that memory-map those arrays.

1. Word counts: map tasks hash the words of whole texts and hand sorted runs of
   (word hash, count) to hash-range shards. A word's id is its place in the
   sorted array of all training words.
2. Bigram counts: a bigram is the exact 64-bit key (context id, word id). Runs
   go to shards by a hash of the key, so a frequent context is spread over all
   shards. Each shard writes its sorted keys and counts and hands on its
   shares of the per-word statistics: how many followers of a context occur
   once, twice and more often, and how many contexts a word follows. They go to the
   words' shards; from ``TWO_HOPS`` shards on in two hops, between groups of shards
   and then inside them, so that the rows handed on do not grow with the square of
   the shards.
3. Scoring: tasks look up the words and bigrams of their texts in the mapped
   arrays. P(v|u) = max(c(uv)-D(c(uv)),0)/c(u) + l(u) Pc(v), where Pc is the
   continuation distribution, discounted the same way and interpolated with
   the uniform distribution over the V training tokens and one unknown token.
   The discounts D1, D2, D3+ of either level come from its counts of counts.

The model grows with the corpus: no n-gram is pruned, sampled or capped. The
order is two (see the README for the figures behind that choice).

Defined cases: a null text is the empty text, which has one token, the end. A
row with a null id is scored, held out and not learned from. Repeated rows
count as often as they occur. An empty training set gives the uniform
distribution over one unknown token (log probability 0). Other columns of the
input are ignored and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm import store as S
from hunkline.llm.runtime import arrow_map, fields, remainder, ship, workdir
from hunkline.llm.textscan import NOT_SPACE, U64, Words, scan

TWO_HOPS = 1 << 11

_PART = fields(("shard", T.LongType()), ("ids", T.BinaryType()), ("stats", T.BinaryType()))


@dataclass
class Model:
    """What tasks need besides the mapped arrays: a few numbers."""

    words: S.Store
    bigrams: S.Store
    texts: int              # training texts: count of the end token, and of the begin context
    tokens: int             # training tokens, ends included (N)
    distinct: int           # distinct training tokens, the end included (V)
    types: int              # distinct bigrams
    begin: tuple[int, ...]  # followers of the begin context seen 1, 2, 3+ times
    end_contexts: int       # contexts that the end follows
    high: tuple[float, ...]  # discounts of bigram counts
    low: tuple[float, ...]  # discounts of continuation counts
    low_mass: float         # weight of the uniform distribution

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def start(self) -> int:
        return len(self.words) + 1


def discounts(n: list[int]) -> tuple[float, ...]:
    """D1, D2, D3+ from the numbers of items that occur 1, 2, 3 and 4 times.
    Where a number is 0 the estimate does not exist; the discount is then half
    the count. It is never above the count, and never below 0.1, so that every
    context leaves some probability to tokens it has not seen."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.0
    for i in (1, 2, 3):
        d = i - (i + 1) * y * n[i] / n[i - 1] if y and n[i - 1] and n[i] else i / 2
        out.append(float(min(max(d, 0.1), i)))
    return tuple(out)


def token_ids(w: Words, words: S.Store, columns: tuple[str, ...] = ()) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Ids of the words (-1: unknown) and the asked columns, word by word."""
    distinct, place = np.unique(w.hashes, return_inverse=True)
    got = words.lookup(distinct, columns)
    return got["id"][place], {c: got[c][place] for c in columns}


def _pairs(ids: np.ndarray, w: Words, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, token) of every token of every text."""
    return np.insert(ids, w.first[:-1], start), np.insert(ids, w.first[1:], end)


def _key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u.astype(U64) << U64(32)) | v.astype(U64)


def _dealt(ids: np.ndarray, stats: np.ndarray, words: S.Store, group_bits: int = 0) -> list[tuple[int, bytes, bytes]]:
    """Statistics by the shard of their words (or by groups of 2**group_bits of
    them); ids beyond the words (end, begin) go to one more shard."""
    shards = 1 << words.bits
    owner = np.minimum(np.searchsorted(words.base, ids, side="right") - 1, shards) >> group_bits
    there, first = np.unique(owner, return_index=True)  # ids ascend, so owners do
    ends = np.append(first[1:], len(ids))
    return [(int(o), S.pack_keys(ids[a:b].astype(U64)), S.pack(stats[a:b].astype("<u4").ravel())) for o, a, b in zip(there, first, ends)]


def _parts(rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.binary()),
                     "stats": pa.array([r[2] for r in rows], pa.binary())})


def _added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the statistics of all rows, by id."""
    return S.summed(np.concatenate([S.unpack_keys(x) for x in table.column("ids").to_pylist()]).astype(np.int64),
                    np.concatenate([S.unpack(x, "<u4").reshape(-1, 4) for x in table.column("stats").to_pylist()]).astype(np.int64))


def _regroup(words: S.Store):
    """The second hop: what some shards of bigrams say of some shards of words."""
    def group(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table
        return _parts(_dealt(*_added(table), words))
    return group


def _merge_bigrams(folder: str, words: S.Store, group_bits: int = 0):
    def group(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        k, c = S.merge_runs(table.column("keys").to_pylist(), table.column("counts").to_pylist())
        S.save(folder, shard, key=k, count=S.narrow(c))
        # the shard's share of each word's statistics: followers seen 1, 2, 3+ times, contexts
        u, v = (k >> U64(32)).astype(np.int64), (k & U64(0xFFFFFFFF)).astype(np.int64)
        share = np.zeros((len(k), 4), np.int64)
        share[np.arange(len(k)), np.minimum(c, 3) - 1] = 1
        after, one = S.summed(u, share)
        words_seen, n = np.unique(v, return_counts=True)
        before = np.zeros((len(words_seen), 4), np.int64)
        before[:, 3] = n
        ids, stats = S.summed(np.concatenate([after, words_seen]), np.concatenate([one, before]))
        rows = _dealt(ids, stats, words, group_bits)
        if group_bits:  # by group of bigram shards and group of word shards
            rows = [((shard >> group_bits) << 32 | owner, *blocks) for owner, *blocks in rows]
        tally = np.array([len(k), *[(c == i).sum() for i in (1, 2, 3, 4)], shard], np.int64)
        return _parts([*rows, (-1, tally.tobytes(), b"")])
    return group


def _merge_stats(words: S.Store):
    shards = 1 << words.bits

    def group(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        if shard < 0:  # the shards' tallies: one short row each
            rows = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
            return _summary(shard, np.concatenate(rows))
        ids, stats = _added(table)
        if shard == shards:
            return _summary(shard, np.concatenate([ids[:, None], stats], axis=1).ravel())
        full = np.zeros((int(words.base[shard + 1] - words.base[shard]), 4), np.uint32)
        full[ids - words.base[shard]] = stats
        S.save(words.folder, shard, n1=full[:, 0], n2=full[:, 1], n3=full[:, 2], contexts=full[:, 3])
        contexts = stats[:, 3]
        return _summary(shard, np.array([*[(contexts == i).sum() for i in (1, 2, 3, 4)], (contexts >= 3).sum()]))

    def _summary(shard: int, numbers: np.ndarray) -> pa.Table:
        return pa.table({"shard": pa.array([shard], pa.int32()),
                         "numbers": pa.array([[int(x) for x in numbers]], pa.list_(pa.int64()))})
    return group


def train(df: DataFrame, text: str = "text", two_hops: int = TWO_HOPS) -> Model:
    """Count the model over all rows of ``df`` (two passes over the texts)."""
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_texts, n_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = S.shard_bits(n_bytes)
    words, total = S.count_keys(texts, bits, workdir(spark, "lm-words"), S.word_keys(NOT_SPACE, lambda w: w.hashes))
    bigram_folder = workdir(spark, "lm-bigrams")
    if len(words) + 2 >= 1 << 32:
        raise ValueError("over 2**32 distinct words: bigram keys of two 32-bit ids do not hold them")
    start, end = len(words) + 1, len(words)

    def pair_keys(w: Words) -> np.ndarray:
        return _key(*_pairs(token_ids(w, words)[0], w, start, end))

    group_bits = (bits + 1) // 2 if 1 << bits >= two_hops else 0
    shares = (S.key_runs(texts, bits, True, S.word_keys(NOT_SPACE, pair_keys))
              .groupBy("shard").applyInArrow(_merge_bigrams(bigram_folder, words, group_bits), _PART))
    if group_bits:
        shares = shares.groupBy("shard").applyInArrow(_regroup(words), _PART)
    summary = (shares.groupBy("shard").applyInArrow(_merge_stats(words), "shard int, numbers array<long>").collect())
    bigram_sizes, high, low, low3, begin, end_contexts = [0] * (1 << bits), [0] * 4, [0] * 4, 0, (0, 0, 0), 0
    for r in summary:
        x = r.numbers
        if r.shard == -1:
            for i in range(0, len(x), 6):
                bigram_sizes[x[i + 5]] = x[i]
                high = [a + b for a, b in zip(high, x[i + 1:i + 5])]
        elif r.shard == 1 << bits:
            for i in range(0, len(x), 5):
                if x[i] == start:
                    begin = tuple(x[i + 1:i + 4])
                else:
                    end_contexts = x[i + 4]
        else:
            low, low3 = [a + b for a, b in zip(low, x)], low3 + x[4]
    for i in range(1, 5):
        low[i - 1] += end_contexts == i
    low3 += end_contexts >= 3
    types = sum(bigram_sizes)
    d_low = discounts(low)
    mass = (d_low[0] * low[0] + d_low[1] * low[1] + d_low[2] * low3) / types if types else 1.0
    return Model(words, S.Store(bigram_folder, bits, bigram_sizes, mixed=True), n_texts,
                 total + n_texts, len(words) + (n_texts > 0), types,
                 begin, end_contexts, discounts(high), d_low, mass)


def _discount(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def log_probs(w: Words, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(token | context) and the training count of every token (the end
    of each text included), text after text."""
    ids, got = token_ids(w, m.words, ("count", "n1", "n2", "n3", "contexts") if m.types else ("count",))
    known = np.where(ids >= 0, ids, m.end + 2)
    u, v = _pairs(known, w, m.start, m.end)
    count = np.insert(got["count"], w.first[1:], m.texts)
    if not m.types:
        return np.full(len(v), -np.log10(m.distinct + 1.0)), count
    contexts = np.insert(got["contexts"], w.first[1:], m.end_contexts)
    low = np.maximum(contexts - _discount(contexts, m.low), 0) / m.types + m.low_mass / (m.distinct + 1)
    total = np.insert(got["count"], w.first[:-1], m.texts)
    held = sum(m.high[i] * np.insert(got[f"n{i + 1}"], w.first[:-1], m.begin[i]) for i in range(3))
    keys, place = np.unique(_key(u, v), return_inverse=True)
    pair = m.bigrams.lookup(keys, ("count",))["count"][place]
    seen = np.maximum(total, 1)
    p = np.where(total > 0, np.maximum(pair - _discount(pair, m.high), 0) / seen + held / seen * low, low)
    return np.log10(p), count


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text",
          held_out: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens,
    base_score (add-0.1 unigrams) and score (log10 probability of the text)."""
    kind = df.schema[id_col].dataType
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).alias("id"),
                     (F.lit(False) if held_out is None else held_out).alias("held_out"))
    n, v = model.tokens, model.distinct
    schema = fields((id_col, kind), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()),
                    ("n_known", T.LongType()), ("train_tokens", T.LongType()),
                    ("base_score", T.DoubleType()), ("score", T.DoubleType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, b, w in scan(batch.column(0), NOT_SPACE):
                logp, count = log_probs(w, model)
                at = w.first[:-1] + np.arange(b - a)  # first token of each text, ends inserted
                base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
                for to, values in zip(out, (np.diff(w.first) + 1, np.add.reduceat((count > 0).astype(np.int64), at),
                                            np.add.reduceat(base, at), np.add.reduceat(logp, at))):
                    to.append(values)
            size = batch.num_rows
            if not size:
                continue
            cols = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(np.full(size, n), pa.int64()), pa.array(cols[2]), pa.array(cols[3])],
                names=schema.names)

    return arrow_map(rows, task, schema)


def train_and_score(df: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Learn from rows whose id's crc32 modulo ``folds`` is not 0; score all."""
    fold = remainder(F.col(id_col), folds)
    model = train(df.filter(fold != 0), text)
    return score(df, model, id_col, text, F.coalesce(fold == 0, F.lit(True)))
