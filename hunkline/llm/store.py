"""Sorted hash arrays in the shared folder, built by Spark and memory-mapped.

Map tasks count 64-bit keys with numpy and hand over sorted runs, one binary
block per shard; Spark shuffles the blocks by shard; a reduce task merges the
runs of its shard and writes the shard's arrays as ``.npy`` files in the shared
folder (written under a temporary name, then renamed, so a task that runs
twice leaves the same files). Readers memory-map the shards they touch.

A shard is a slice of the hash space, so its size follows the number of
distinct keys; a hot key is one entry of each run.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm.runtime import arrow_map, checkpointed, fields
from hunkline.llm.textscan import U64, Words, mix64, scan

RUN = fields(("shard", T.IntegerType()), ("keys", T.BinaryType()), ("counts", T.BinaryType()))

#: entries that a map task gathers before it hands them over
RUN_ENTRIES = 3_000_000
#: bytes of text behind one shard: the entries of a shard fit a task's memory
SHARD_TEXT_BYTES = 24 << 20
#: distinct keys of one shard of a store of keys
SHARD_KEYS = 1 << 20


def shard_bits(text_bytes: int) -> int:
    """Bits of the shard number, from the corpus size (at least 32 shards)."""
    return max(5, int(np.ceil(np.log2(max(text_bytes, 1) / SHARD_TEXT_BYTES))) if text_bytes > SHARD_TEXT_BYTES else 5)


def route(keys: np.ndarray, bits: int, mixed: bool) -> np.ndarray:
    return ((mix64(keys) if mixed else keys) >> U64(64 - bits)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes: high bytes lie together and compress well."""
    v = np.ascontiguousarray(values)
    return v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.tobytes()


def unpack(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=U64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts (1-D or 2-D)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at, axis=0)


class Runs:
    """Counts keys and yields (shard, keys block, counts block)."""

    def __init__(self, bits: int, mixed: bool = False) -> None:
        self.bits, self.mixed, self.parts, self.held = bits, mixed, [], 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        k, c = np.unique(keys, return_counts=True)
        self.parts.append((k, c.astype(np.int64)))
        self.held += len(k)
        if self.held >= RUN_ENTRIES:
            self._merge()
            if self.held >= RUN_ENTRIES // 2:
                yield from self.flush()

    def _merge(self) -> None:
        k = np.concatenate([p[0] for p in self.parts])
        c = np.concatenate([p[1] for p in self.parts])
        self.parts = [summed(k, c)]
        self.held = len(self.parts[0][0])

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        if not self.parts:
            return
        self._merge()
        (k, c), self.parts, self.held = self.parts[0], [], 0
        s = route(k, self.bits, self.mixed)
        if self.mixed:
            order = np.argsort(s, kind="stable")
            k, c, s = k[order], c[order], s[order]
        cuts = np.searchsorted(s, np.arange((1 << self.bits) + 1))
        for shard in np.unique(s):
            a, b = cuts[shard], cuts[shard + 1]
            yield int(shard), pack_keys(k[a:b]), pack(c[a:b].astype("<u4"))


def merge_runs(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([unpack_keys(k) for k in keys]),
                  np.concatenate([unpack(c, "<u4").astype(np.int64) for c in counts]))


def save(folder: str, shard: int, **arrays: np.ndarray) -> None:
    for name, values in arrays.items():
        path = os.path.join(folder, f"{shard:06d}.{name}.npy")
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            np.save(f, np.ascontiguousarray(values))
        os.replace(part, path)


class Store:
    """Reader of the shards of one folder. ``sizes[s]`` is the number of keys of
    shard ``s``; a key's id is its place in the whole sorted array."""

    def __init__(self, folder: str, bits: int, sizes: list[int], mixed: bool = False) -> None:
        self.folder, self.bits, self.mixed = folder, bits, mixed
        self.base = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
        self._open: dict[tuple[int, str], np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def __len__(self) -> int:
        return int(self.base[-1])

    def array(self, shard: int, name: str) -> np.ndarray:
        if (shard, name) not in self._open:
            self._open[shard, name] = np.load(os.path.join(self.folder, f"{shard:06d}.{name}.npy"), mmap_mode="r")
        return self._open[shard, name]

    def lookup(self, keys: np.ndarray, columns: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
        """For sorted distinct keys: ``id`` (-1: absent) and the columns' values
        (0 where absent)."""
        s = route(keys, self.bits, self.mixed)
        order = np.argsort(s, kind="stable") if self.mixed else None
        q, s = (keys, s) if order is None else (keys[order], s[order])
        out = {"id": np.full(len(q), -1, np.int64)} | {c: np.zeros(len(q), np.int64) for c in columns}
        cuts = np.searchsorted(s, np.arange((1 << self.bits) + 1))
        for shard in np.unique(s):
            a, b = cuts[shard], cuts[shard + 1]
            if self.base[shard + 1] == self.base[shard]:
                continue
            k = self.array(shard, "key")
            i = np.minimum(np.searchsorted(k, q[a:b]), len(k) - 1)
            hit = np.flatnonzero(k[i] == q[a:b])
            out["id"][a + hit] = self.base[shard] + i[hit]
            for c in columns:
                out[c][a + hit] = self.array(shard, c)[i[hit]]
        if order is not None:
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            out = {c: v[back] for c, v in out.items()}
        return out


def word_keys(table: np.ndarray, keys_of: Callable[[Words], np.ndarray]) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    """Keys of the words of the texts in a batch's first column."""
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, words in scan(batch.column(0), table):
            yield keys_of(words)
    return keys


def key_runs(df: DataFrame, bits: int, mixed: bool, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """Sorted runs (shard, keys, counts) of all keys that ``keys`` yields."""
    def batch_of(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([r[2] for r in rows], pa.binary())], names=RUN.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(bits, mixed)
        for batch in batches:
            for part in keys(batch):
                if rows := list(runs.add(part)):
                    yield batch_of(rows)
        if rows := list(runs.flush()):
            yield batch_of(rows)

    return arrow_map(df, task, RUN)


def count_keys(df: DataFrame, bits: int, folder: str, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
               least: int = 1) -> tuple[Store, int]:
    """Write a store of the distinct keys that occur ``least`` times or more, with
    their counts (columns ``key`` and ``count``); also returns the sum of all counts."""
    def group(data: pa.Table) -> pa.Table:
        shard = data.column("shard")[0].as_py()
        k, c = merge_runs(data.column("keys").to_pylist(), data.column("counts").to_pylist())
        total, often = int(c.sum()), c >= least
        save(folder, shard, key=k[often], count=narrow(c[often]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([int(often.sum())], pa.int64()),
                         "total": pa.array([total], pa.int64())})

    rows = (key_runs(df, bits, False, keys)
            .groupBy("shard").applyInArrow(group, "shard int, n long, total long").collect())
    sizes = [0] * (1 << bits)
    for r in rows:
        sizes[r.shard] = r.n
    return Store(folder, bits, sizes), sum(r.total for r in rows)


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.int64)


def save_keys(keys: DataFrame, folder: str) -> Store:
    """Write a store of the distinct 64-bit keys in the first column of ``keys``.
    Keys go to shards by their hash, as ids are small numbers; the number of
    shards follows the number of keys."""
    distinct = checkpointed(keys.select(F.col(keys.columns[0]).cast("long").alias("key")).filter(F.col("key").isNotNull()).distinct())
    bits = max(5, int(np.ceil(np.log2(max(distinct.count() / SHARD_KEYS, 1)))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = route(batch.column(0).to_numpy().view(U64), bits, True).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard)], names=["key", "shard"])

    def group(data: pa.Table) -> pa.Table:
        k = np.unique(data.column("key").to_numpy().view(U64))
        shard = data.column("shard")[0].as_py()
        save(folder, shard, key=k)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(k)], pa.int64())})

    rows = (arrow_map(distinct, task, fields(("key", T.LongType()), ("shard", T.IntegerType())))
            .groupBy("shard").applyInArrow(group, "shard int, n long").collect())
    sizes = [0] * (1 << bits)
    for r in rows:
        sizes[r.shard] = r.n
    return Store(folder, bits, sizes, mixed=True)


def without(df: DataFrame, id_col: str, gone: Store) -> DataFrame:
    """The rows of ``df`` whose integer id is not in the store. No shuffle: tasks
    look the ids up in the mapped arrays. Rows with a null id stay."""
    place = df.columns.index(id_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(place)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            distinct, at = np.unique(values, return_inverse=True)
            stay = (gone.lookup(distinct)["id"] < 0)[at] | ~ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(stay))

    return arrow_map(df, task, df.schema)
