"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that starts somewhere else
too goes, in all its occurrences. The suffix arrays are sparse and still exact:

1. Anchors. A string of ``LENGTH`` bytes holds a fixed number of grams of ``GRAM``
   bytes; its anchor is the first of those with the smallest hash. Equal strings have
   equal anchors at equal places, so suffixes need to be sorted from anchors on only
   (about one byte in a hundred). Consecutive strings with one anchor are one
   *context*: the bytes from the first one's start to the last one's end.
2. Tasks count the grams at anchors; Spark adds them up. A gram that occurs once
   has no equal string, and its context is left out.
3. The other contexts, each once (with a multiplicity), are dealt to shards by the
   gram's hash, so contexts that may share strings meet.
4. A shard's contexts arrive in batches. A batch becomes a suffix array (contexts in
   the order of the bytes from the anchor on) and is merge-scanned against every
   existing level; then levels of equal size merge, so there are at most log2 of
   the batches. The scan finds the runs that share the gram, the common prefixes of
   neighbours, and the common suffixes before the anchor: two contexts share the
   string that starts ``o`` bytes before the anchor if they agree in ``o`` bytes
   before it and ``LENGTH - o`` after. For each ``o`` contexts that agree in both are
   grouped (not paired), and groups of two or more are repeated strings.
5. The repeated starts of each context are stored as sorted arrays in the shared
   folder; a last pass over the texts maps them, covers the bytes and drops them.

Texts are never shuffled, and rows need no identity: what is stored depends on
the bytes alone, so rows with equal or null ids are occurrences of their own.
A gram with more contexts than ``RUN_LIMIT`` (a passage shorter than ``LENGTH`` that
a third of all documents hold) is not brought into one task: the strings of such
contexts are counted one by one, by 128-bit hash, with the same result.

Contexts are told apart by a 128-bit hash, grams by their bytes. Defined cases: null
and empty texts have no bytes; texts shorter than ``LENGTH`` stay whole. Other columns
are ignored and cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkline.llm import store as S
from hunkline.llm.runtime import arrow_map, fields, stored, take, workdir
from hunkline.llm.textscan import _BYTE_VALUES, _POWERS, U64, buffers, mix64, steps

LENGTH = 400
GRAM = 200
PIECE = 1 << 20            # starts of strings that are hashed in one step
TASK_GRAMS = 1_000_000     # grams that a task gathers before it hands them over
TASK_BYTES = 16 << 20      # bytes of contexts, likewise
SHARD_CONTEXTS = 16_384    # contexts of a shard, on average
BATCH = 2_048              # contexts of a batch
RUN_LIMIT = 8_192          # contexts of one gram in a shard
_PLACE = U64((1 << 21) - 1)
_OTHER_VALUES = mix64(_BYTE_VALUES + U64(0x9E3779B97F4A7C15))
_WORDS = 4                 # 64-bit words of a context's mask of repeated starts
_MASK = tuple(f"m{i}" for i in range(_WORDS))


# --- anchors ----------------------------------------------------------------

class Hashes:
    """Polynomial hashes of the substrings of ``data``."""

    def __init__(self, data: np.ndarray, values: np.ndarray) -> None:
        n = len(data)
        up, self.down = _POWERS.upto(n + 1)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(values[data] * up[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    padded = np.full(-(-len(values) // width) * width, np.iinfo(U64).max, U64)
    padded[:len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    n = len(values) - width + 1
    return np.minimum(ahead[:n], behind[width - 1:width - 1 + n])


class Contexts:
    """Contexts of one piece of consecutive texts: ``anchor``, the starts of its
    first and last string (``lo``, ``hi``), and the gram's hash."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, length: int, gram: int) -> None:
        self.length = length
        n = len(data) - length + 1
        self.first = Hashes(data, _BYTE_VALUES)
        at = np.arange(len(data) - gram + 1)
        grams = mix64(self.first.of(at, at + gram))
        anchor = (_sliding_min((grams & ~_PLACE) | at.astype(U64), length - gram + 1) & _PLACE).astype(np.int64)
        crossing = np.zeros(n + 1, np.int32)  # strings that cross a border of texts
        inside = borders[(borders > 0) & (borders < len(data))]
        np.add.at(crossing, np.clip(inside - length + 1, 0, n), 1)
        np.add.at(crossing, np.clip(inside, 0, n), -1)
        starts = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
        if len(starts):
            new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) > 1) | (np.diff(anchor[starts]) != 0))))
            self.lo, self.hi = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        else:
            self.lo = self.hi = starts
        self.anchor = anchor[self.lo]
        self.gram = grams[self.anchor]
        self.data = data

    def only(self, chosen: np.ndarray) -> None:
        self.lo, self.hi, self.anchor, self.gram = self.lo[chosen], self.hi[chosen], self.anchor[chosen], self.gram[chosen]

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each context: its bytes and its anchor's place in them."""
        shape = (self.anchor - self.lo).astype(U64) * U64(0xA24BAED4963EE407) + (self.hi - self.lo).astype(U64) * U64(0x9FB21C651E98DF25)
        end = self.hi + self.length
        return tuple(mix64(h.of(self.lo, end) + shape) for h in (self.first, Hashes(self.data, _OTHER_VALUES)))


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, Contexts]]:
    """(place of the piece in ``data``, its contexts)."""
    for at in range(0, len(data) - length + 1, PIECE):
        yield at, Contexts(data[at:at + PIECE + length - 1], offsets - at, length, gram)


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of steps of whole texts."""
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for a, b in steps(offsets):
            yield batch.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def repeated_grams(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Hashes of the grams at two or more anchors."""
    schema = fields(("key", "long"), ("n", "long"))

    def hand_over(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=schema.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for _, data, offsets in _texts(batches):
            parts += [c.gram for _, c in contexts(data, offsets, length, gram)]
            if sum(map(len, parts)) >= TASK_GRAMS:
                yield hand_over(parts)
                parts = []
        if parts:
            yield hand_over(parts)

    return arrow_map(texts, task, schema).groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("key")


def repeated_contexts(texts: DataFrame, grams: S.Store, length: int, gram: int) -> DataFrame:
    """(gram, c1, c2, most, least, bytes, n): the distinct contexts at repeated grams,
    with the most and the fewest bytes that their strings have before the anchor."""
    schema = fields(*[(c, "long") for c in ("gram", "c1", "c2")], ("most", "integer"), ("least", "integer"), ("bytes", "binary"), ("n", "long"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def hand_over() -> pa.RecordBatch:
            rows = list(held.values())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        arrow = pa.schema([pa.field(c, pa.int64()) for c in ("gram", "c1", "c2")] + [pa.field(c, pa.int32()) for c in ("most", "least")]
                          + [pa.field("bytes", pa.binary()), pa.field("n", pa.int64())])
        for _, data, offsets in _texts(batches):
            for _, c in contexts(data, offsets, length, gram):
                distinct, place = np.unique(c.gram, return_inverse=True)
                c.only(np.flatnonzero((grams.lookup(distinct)["id"] >= 0)[place]))
                if not len(c.gram):
                    continue
                c1, c2 = c.identity()
                raw = c.data.tobytes()
                for g, x, y, most, least, lo, end in zip(*(v.tolist() for v in (
                        c.gram.view(np.int64), c1.view(np.int64), c2.view(np.int64), c.anchor - c.lo, c.anchor - c.hi, c.lo, c.hi + length))):
                    row = held.get((x, y))
                    if row is None:
                        held[x, y] = [g, x, y, most, least, raw[lo:end], 1]
                        size += end - lo
                    else:
                        row[6] += 1
                if size >= TASK_BYTES:
                    yield hand_over()
                    held, size = {}, 0
        if held:
            yield hand_over()

    return (arrow_map(texts, task, schema).groupBy("gram", "c1", "c2")
            .agg(F.first("most").alias("most"), F.first("least").alias("least"), F.first("bytes").alias("bytes"), F.sum("n").alias("n")))


# --- the suffix arrays ------------------------------------------------------

def _agreement(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of a byte matrix with the next one."""
    out = np.zeros(max(len(rows) - 1, 0), np.int64)
    for at in range(0, len(out), 4096):
        a = rows[at:at + 4097]
        differs = a[1:] != a[:-1]
        out[at:at + len(differs)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


class Family:
    """Levels of suffix arrays over contexts; ``repeated[i, o]`` tells whether the
    string that starts ``o`` bytes before context ``i``'s anchor occurs twice."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        width = length - gram
        self.after = np.zeros((0, length), np.uint8)     # bytes from the anchor on
        self.before = np.zeros((0, width), np.uint8)     # bytes before it, the nearest first
        self.most = self.least = np.zeros(0, np.int64)
        self.repeated = np.zeros((0, width + 1), bool)
        self.levels: list[np.ndarray] = []

    def _order(self, rows: np.ndarray) -> np.ndarray:
        """A matrix as one sortable byte string a row."""
        return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()

    def add(self, data: np.ndarray, start: np.ndarray, most: np.ndarray, least: np.ndarray, n: np.ndarray) -> None:
        """A batch: contexts from ``start`` in ``data`` on, with multiplicities ``n``."""
        at = (start + most)[:, None]
        ends = self.length - least[:, None]
        offset = np.arange(self.length)
        after = np.where(offset < ends, data[np.minimum(at + offset, len(data) - 1)], 0).astype(np.uint8)
        offset = np.arange(self.length - self.gram)
        before = np.where(offset < most[:, None], data[np.maximum(at - 1 - offset, 0)], 0).astype(np.uint8)
        o = np.arange(self.length - self.gram + 1)
        twice = (n > 1)[:, None] & (o >= least[:, None]) & (o <= most[:, None])
        first = len(self.most)
        self.after, self.before = np.concatenate([self.after, after]), np.concatenate([self.before, before])
        self.most, self.least = np.concatenate([self.most, most]), np.concatenate([self.least, least])
        self.repeated = np.concatenate([self.repeated, twice])
        new = first + np.argsort(self._order(after), kind="stable")
        self._scan(new)
        for level in self.levels:
            self._scan(self._merged(level, new), len(level))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            small, large = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(large, small))

    def _merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Two suffix arrays as one."""
        return np.insert(x, np.searchsorted(self._order(self.after[x]), self._order(self.after[y]), side="right"), y)

    def _scan(self, order: np.ndarray, old: int = 0) -> None:
        """Mark the strings that contexts of a suffix array share. ``old``: only runs
        that hold entries of both sides can tell something new."""
        if len(order) < 2:
            return
        common = _agreement(self.after[order])
        run = np.concatenate(([0], np.cumsum(common < self.gram)))
        sizes = np.bincount(run)
        keep = sizes[run] > 1
        if old:
            new_from = len(self.most) - (len(order) - old)
            news = np.bincount(run, order >= new_from)
            keep &= (news[run] > 0) & (news[run] < sizes[run])
        chosen = np.flatnonzero(keep)
        if not len(chosen):
            return
        ids, n = order[chosen], len(chosen)
        # neighbours that were not neighbours before lie in different runs
        common = np.where(np.diff(chosen) == 1, common[np.minimum(chosen[:-1], len(common) - 1)], 0)
        by_left = np.argsort(self._order(self.before[ids]), kind="stable")
        left_common = _agreement(self.before[ids[by_left]])
        most, least, run = self.most[ids], self.least[ids], run[chosen]
        left = np.zeros(n, np.int64)
        for o in range(self.length - self.gram + 1):
            can = np.flatnonzero((most >= o) & (least <= o))
            if len(can) < 2:
                continue
            right = np.concatenate(([0], np.cumsum(common < self.length - o)))
            left[by_left] = np.concatenate(([0], np.cumsum(left_common < o)))
            key = right[can] * n + left[can]
            sort = np.argsort(key, kind="stable")
            key = key[sort]
            equal = key[1:] == key[:-1]
            hit = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
            self.repeated[ids[can[sort[hit]]], o] = True


def _masks(repeated: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words."""
    wide = np.zeros((len(repeated), 64 * _WORDS), bool)
    wide[:, :repeated.shape[1]] = repeated
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


_FOUND = fields(("k1", "long"), ("k2", "long"), *[(m, "long") for m in _MASK])


def _found(c1: np.ndarray, c2: np.ndarray, masks: np.ndarray) -> list[pa.Array]:
    return [pa.array(c1), pa.array(c2), *(pa.array(np.ascontiguousarray(masks[:, i]).view(np.int64)) for i in range(_WORDS))]


def family_matches(found: DataFrame, shards: int, length: int, gram: int) -> DataFrame:
    """(k1, k2, mask words) of the contexts with repeated strings, shard by shard."""
    def shard(data: pa.Table) -> pa.Table:
        data = data.sort_by([("c1", "ascending"), ("c2", "ascending")]).combine_chunks()
        family = Family(length, gram)
        most, least, n = (data.column(c).to_numpy().astype(np.int64) for c in ("most", "least", "n"))
        for at in range(0, data.num_rows, BATCH):
            part = data.column("bytes").slice(at, BATCH).cast(pa.large_binary()).combine_chunks()
            part = part.chunk(0) if isinstance(part, pa.ChunkedArray) else part
            raw, to = np.frombuffer(part.buffers()[2], np.uint8), at + len(part)
            start = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)[:-1]
            family.add(raw, start, most[at:to], least[at:to], n[at:to])
        hit = np.flatnonzero(family.repeated.any(axis=1))
        return pa.Table.from_arrays(_found(data.column("c1").to_numpy()[hit], data.column("c2").to_numpy()[hit],
                                           _masks(family.repeated[hit])), names=_FOUND.names)

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(shard, _FOUND)


def _window_hashes(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    at = np.arange(len(data) - length + 1)
    return tuple(mix64(Hashes(data, v).of(at, at + length)) for v in (_BYTE_VALUES, _OTHER_VALUES))


def counted_matches(found: DataFrame, length: int) -> DataFrame:
    """The same for contexts of very frequent grams: their strings are counted."""
    schema = fields(("k1", "long"), ("k2", "long"), ("n", "long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_window_hashes(raw, length) for raw in batch.column(0).to_pylist()]
            if keys:
                n = np.repeat(batch.column(1).to_numpy(), [len(k[0]) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[i] for k in keys]).view(np.int64)) for i in (0, 1)] + [pa.array(n)],
                                                 names=schema.names)

    strings = arrow_map(found.select("bytes", "n"), count, schema).groupBy("k1", "k2").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    known = PairStore(strings.select("k1", "k2", *[F.lit(0).cast("long").alias(m) for m in _MASK]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hits = [], []
            for i, (raw, most) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                hit = known.lookup(*_window_hashes(raw, length))[0] >= 0
                if hit.any():
                    flags = np.zeros(64 * _WORDS, bool)
                    flags[most - np.flatnonzero(hit)] = True
                    rows.append(i)
                    hits.append(flags)
            if rows:
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(_found(part.column(0).to_numpy(), part.column(1).to_numpy(), _masks(np.array(hits))), names=_FOUND.names)

    return arrow_map(found.select("c1", "c2", "bytes", "most"), mark, _FOUND)


class PairStore:
    """128-bit keys with a context's mask, as sorted arrays in the shared folder."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        rows = stored(rows, "repeated")
        bits = max(5, int(np.ceil(np.log2(max(rows.count() / S.SHARD_KEYS, 1)))))
        self.folder, self.bits = workdir(spark, "repeated"), bits
        folder = self.folder

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = S.route(batch.column(0).to_numpy().view(U64), bits, False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

        def group(data: pa.Table) -> pa.Table:
            columns = [data.column(c).to_numpy().view(U64) for c in ("k1", "k2", *_MASK)]
            order = np.lexsort((columns[1], columns[0]))
            shard = data.column("shard")[0].as_py()
            S.save(folder, shard, k1=columns[0][order], k2=columns[1][order], mask=np.stack(columns[2:], axis=1)[order])
            return pa.table({"shard": pa.array([shard], pa.int32())})

        dealt = arrow_map(rows, task, fields(*[(f.name, f.dataType) for f in rows.schema], ("shard", "integer")))
        self.shards = {r.shard for r in dealt.groupBy("shard").applyInArrow(group, "shard int").collect()}
        self._store = S.Store(folder, bits, [0] * (1 << bits))

    def lookup(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in its shard or -1, mask) of each key."""
        place, masks = np.full(len(k1), -1, np.int64), np.zeros((len(k1), _WORDS), U64)
        shard = S.route(k1, self.bits, False)
        for s in self.shards.intersection(np.unique(shard).tolist()):
            mine = np.flatnonzero(shard == s)
            keys, others = self._store.array(s, "k1"), self._store.array(s, "k2")
            at = np.searchsorted(keys, k1[mine])
            while len(mine):  # keys equal in the first half lie side by side
                inside = at < len(keys)
                mine, at = mine[inside], at[inside]
                same = keys[at] == k1[mine]
                mine, at = mine[same], at[same]
                hit = others[at] == k2[mine]
                place[mine[hit]] = at[hit]
                masks[mine[hit]] = self._store.array(s, "mask")[at[hit]]
                mine, at = mine[~hit], at[~hit] + 1
        return place, masks


# --- the operator -----------------------------------------------------------

def _covered(data: np.ndarray, offsets: np.ndarray, known: PairStore, length: int, gram: int) -> np.ndarray:
    """Bytes that lie in a repeated string."""
    edge = np.zeros(len(data) + 1, np.int8)
    for at, c in contexts(data, offsets, length, gram):
        place, masks = known.lookup(*c.identity())
        hit = np.flatnonzero(place >= 0)
        if not len(hit):
            continue
        count = c.hi[hit] - c.lo[hit] + 1
        which = np.repeat(hit, count)
        start = c.lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        o = c.anchor[which] - start
        on = (masks[which, o >> 6] >> (o & 63).astype(U64)) & U64(1) == 1
        edge[at + start[on]] += 1
        edge[at + start[on] + length] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
          run_limit: int = RUN_LIMIT, shard_contexts: int = SHARD_CONTEXTS, with_kept: bool = False) -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with
    ``with_kept`` the remaining bytes. ``gram`` is 1 to 255 bytes shorter than ``length``."""
    if not 0 < length - gram < 64 * _WORDS:
        raise ValueError("the gram must be shorter than the string, by less than 256 bytes")
    spark = df.sparkSession
    rows = take(df, text, id_col)
    texts = rows.select(text)
    grams = S.save_keys(repeated_grams(texts, length, gram), workdir(spark, "grams"))
    found = stored(repeated_contexts(texts, grams, length, gram), "contexts")
    shards = max(1, -(-found.count() // shard_contexts))
    hot = found.groupBy("gram").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > run_limit).select("gram")
    hot = stored(hot, "frequent-grams")
    repeated = family_matches(found.join(hot, "gram", "left_anti"), shards, length, gram)
    if hot.limit(1).count():
        repeated = repeated.unionByName(counted_matches(found.join(hot, "gram", "left_semi"), length))
    known = PairStore(repeated)
    schema = fields((id_col, df.schema[df.columns.index(id_col)].dataType), *[(c, "long") for c in ("n_bytes", "n_removed", "n_spans")],
                    ("kept_sha256", "string"), *([("kept", "binary")] if with_kept else []))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _texts(batches):
            gone = _covered(data, offsets, known, length, gram)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            borders = offsets[:-1][offsets[:-1] < len(data)]
            opens[borders] = gone[borders]
            removed, spans = (np.concatenate(([0], np.cumsum(v))) for v in (gone, opens))
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            columns = [batch.column(1), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])),
                       pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_kept else []), names=schema.names)

    return arrow_map(rows, task, schema)
