"""Benchmark decontamination with a distributed positional inverted index.

1. Index: every task turns its documents into blocks. A block is a positional
   inverted index of about ``BLOCK_WORDS`` document words: for each word its postings
   (document, position), ordered. Each holds whole documents and is a compressed
   file in the shared folder, written and read by tasks; Spark itself handles the
   files' names only, so a JVM never holds postings. The index knows no benchmark,
   so it serves any.
2. The benchmark's windows (10 consecutive words of an item; an item of fewer words is
   one window) are written to the shared folder, in files of bounded size.
3. Search: for each block, a window's lists are intersected from its rarest word
   on, each list shifted by the word's offset in the window. What is left are
   the starts of exact phrases. Windows with a word that the block lacks are
   dropped before any list is read. With ``slop`` the same lists also give
   proximity matches: all words of the window, in any order, within a span of
   ``slop`` words more than the window.

Documents are never shuffled and no list is cut short: a block is bounded by its
words (or is one longer document), and windows come in files of bounded size.

Defined cases: null texts have no words; they are neither hit nor match. Rows
of documents are independent of each other, also with equal or null ids. Items
with equal ids count as one item; a null item id counts as the text ``null``.
An empty benchmark hits nothing. Other columns are ignored and cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm import store as S
from hunkline.llm.runtime import arrow_map, fields, release, ship, stored, workdir
from hunkline.llm.textscan import ALNUM, U64, scan

WINDOW = 10
BLOCK_WORDS = 500_000       # document words of an index block
TASK_BLOCKS = 8             # index blocks that a search task reads, one at a time
FILE_ITEMS = 5_000          # items of one file of windows

_BINARY = ("first", "terms", "lists", "docs", "positions")


def _windows(first: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item row, length, words) of all windows; words padded with 0."""
    n = np.diff(first)
    length = np.minimum(n, size)
    count = np.where(n > 0, n - length + 1, 0)
    item = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[item]
    place = start[:, None] + np.arange(size)
    inside = np.arange(size) < length[item][:, None]
    words = np.where(inside, hashes[np.minimum(place, len(hashes) - 1)], U64(0)) if len(hashes) else np.zeros((0, size), U64)
    return item, length[item], words


def write_windows(items: DataFrame, id_col: str, text: str, size: int, folder: str) -> list[str]:
    """Files of windows, written by tasks; returns their names."""
    rows = items.select(F.coalesce(F.col(text), F.lit("")).alias("text"),
                        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILE_ITEMS):
                part = batch.slice(at, FILE_ITEMS)
                names = []
                for a, b, w in scan(part.column(0), ALNUM):
                    item, length, words = _windows(w.first, w.hashes, size)
                    if not len(item):
                        continue
                    name = uuid.uuid4().hex
                    path = os.path.join(folder, name)
                    with open(path + ".part", "wb") as f:
                        np.savez(f, item=item, length=length, words=words,
                                 ids=np.array(part.column(1).slice(a, b - a).to_pylist(), dtype=np.str_))
                    os.replace(path + ".part", path + ".npz")
                    names.append(name + ".npz")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    # a task that runs twice writes a second file; only the names that arrive are read
    return [r.name for r in arrow_map(rows, task, fields(("name", T.StringType()))).collect()]


def build_index(docs: DataFrame, id_col: str, text: str, folder: str) -> DataFrame:
    """Index blocks as files, written by tasks; returns rows of their names. A
    block is one Arrow row: the documents' ids, ``first`` (first word of each
    document, counted through the block), and the inverted lists: ``terms``,
    ``lists`` (start of each term's postings), ``docs`` and ``positions``."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).alias("id"))

    def block(parts: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        first, base = [np.zeros(1, np.int64)], 0
        terms, doc, pos = [], [], []
        for part_ids, part_first, t, d, p in parts:
            terms.append(t)
            doc.append(d + np.int32(sum(len(f) for f in first) - 1))
            pos.append(p)
            first.append(part_first[1:] + base)
            base = first[-1][-1]
        terms, doc, pos = np.concatenate(terms), np.concatenate(doc), np.concatenate(pos)
        order = np.argsort(terms, kind="stable")  # documents and positions stay in order
        ordered = terms[order]
        start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else [])
        values = (np.concatenate(first).astype("<i8"), ordered[start], start.astype("<i8"),
                  doc[order].astype("<i4"), pos[order].astype("<i4"))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            + [pa.array([S.pack(v)], pa.binary()) for v in values], names=["ids", *_BINARY])

    def write(parts: list) -> pa.RecordBatch:
        row, name = block(parts), f"{uuid.uuid4().hex}.arrow"
        path, options = os.path.join(folder, name), pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)
        with pa.OSFile(path + ".part", "wb") as f, pa.ipc.new_file(f, row.schema, options=options) as out:
            out.write_batch(row)
        os.replace(path + ".part", path)
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["name"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        parts, held = [], 0
        for batch in batches:
            for a, b, w in scan(batch.column(0), ALNUM):
                doc = w.text_of()
                place = np.arange(len(w)) - w.first[doc]
                parts.append((batch.column(1).slice(a, b - a), w.first, w.hashes, doc.astype(np.int32), place.astype(np.int32)))
                held += len(w)
                if held >= BLOCK_WORDS:
                    yield write(parts)
                    parts, held = [], 0
        if parts:
            yield write(parts)

    # a task that runs twice writes second files; only the names that arrive are read
    return arrow_map(rows, task, fields(("name", T.StringType())))


class Block:
    """One index block in memory."""

    def __init__(self, row: dict) -> None:
        self.first, self.terms, self.lists = (S.unpack(row["first"], "<i8"), S.unpack(row["terms"], "<u8"), S.unpack(row["lists"], "<i8"))
        docs, positions = S.unpack(row["docs"], "<i4"), S.unpack(row["positions"], "<i4")
        self.postings = (docs.astype(np.int64) << 32) | positions
        self.lists = np.append(self.lists, len(self.postings))

    def postings_of(self, term: int) -> np.ndarray:
        return self.postings[self.lists[term]:self.lists[term + 1]]

    def find(self, windows: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, its words' places in ``terms`` from the rarest on, their
        offsets) of the windows whose words all occur in the block."""
        if not len(self.terms):
            return
        words, length = windows["words"], windows["length"]
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        padding = np.arange(words.shape[1]) >= length[:, None]
        there = (self.terms[place] == words) | padding
        size = np.where(padding, np.iinfo(np.int64).max, np.diff(self.lists)[place])
        order = np.argsort(size, axis=1, kind="stable")
        for w in np.flatnonzero(there.all(axis=1)):
            offsets = order[w, :length[w]]
            yield int(w), place[w, offsets], offsets

    def phrases(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts (document << 32 | position) of the exact phrase: the shifted
        lists intersected from the rarest on."""
        starts = self.postings_of(terms[0])
        starts = starts[(starts & 0xFFFFFFFF) >= offsets[0]] - offsets[0]
        for term, offset in zip(terms[1:], offsets[1:]):
            if not len(starts):
                break
            other = self.postings_of(term)
            at = np.minimum(np.searchsorted(other, starts + offset), len(other) - 1)
            starts = starts[other[at] == starts + offset]
        return starts

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Rows (document << 32 | position, length): the shortest stretch that
        begins at an occurrence of a word of the window and holds all its words
        (each as often as the window has it), at most ``span`` words long."""
        need = {int(t): int((terms == t).sum()) for t in terms}
        rare = self.postings_of(int(terms[0]))
        reach = []  # occurrences of all words that lie near the rarest one
        for t in need:
            own = self.postings_of(t)
            at = np.minimum(np.searchsorted(rare, own), len(rare) - 1)
            close = (np.abs(rare[at] - own) < span) | (np.abs(rare[np.maximum(at - 1, 0)] - own) < span)
            reach.append(np.stack([own[close], np.full(close.sum(), t)]))
        spots = np.concatenate(reach, axis=1)
        spots = spots[:, np.argsort(spots[0], kind="stable")]
        found, have, missing, left = [], dict.fromkeys(need, 0), sum(need.values()), 0
        for at, term in spots.T.tolist():
            have[term] += 1
            missing -= have[term] <= need[term]
            while missing == 0:
                begin, gone = spots[:, left].tolist()
                if at - begin < span:
                    found.append((begin, at - begin + 1))
                have[gone] -= 1
                missing += have[gone] < need[gone]
                left += 1
        return np.array(found, np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[pa.Array, Block]]:
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with pa.OSFile(os.path.join(folder, name), "rb") as f:
                row = pa.ipc.open_file(f).get_batch(0)
            yield row.column(0).flatten(), Block({c: row.column(c)[0].as_py() for c in _BINARY})


def _load(folder: str, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    for name in names:
        with np.load(os.path.join(folder, name)) as f:
            yield {k: f[k] for k in f.files}


class Index:
    """A stored index of documents."""

    def __init__(self, docs: DataFrame, items: DataFrame | None = None, id_col: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> None:
        spark = docs.sparkSession
        ship(spark)
        self.id_col, self.kind = id_col, docs.schema[id_col].dataType
        self.store = workdir(spark, "postings")
        names = stored(build_index(docs, id_col, text, self.store), "blocks")
        self.blocks = names.repartition(max(1, math.ceil(names.count() / TASK_BLOCKS)))  # names only
        if items is not None:
            self.ask(items, item_id, item_text, window)

    def ask(self, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> Index:
        """Take the windows of a benchmark as the next questions."""
        self.folder = workdir(items.sparkSession, "benchmark")
        self.files = write_windows(items, item_id, item_text, window, self.folder)
        return self

    def digest(self) -> DataFrame:
        """One row per document: id, n_words, n_hit (words inside exact phrases),
        n_items, items_sha256, contaminated."""
        store, folder, files = self.store, self.folder, self.files
        schema = fields((self.id_col, self.kind), ("n_words", T.LongType()), ("n_hit", T.LongType()),
                        ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for ids, block in _blocks(batches, store):
                first = block.first
                edge = np.zeros(int(first[-1]) + 1, np.int32)
                items: dict[int, set[str]] = {}
                for windows in _load(folder, files):
                    for w, terms, offsets in block.find(windows):
                        starts = block.phrases(terms, offsets)
                        if not len(starts):
                            continue
                        doc = starts >> 32
                        at = first[doc] + (starts & 0xFFFFFFFF)
                        edge[at] += 1  # the starts of one window are distinct
                        edge[at + len(offsets)] -= 1
                        for d in np.unique(doc).tolist():
                            items.setdefault(d, set()).add(str(windows["ids"][windows["item"][w]]))
                hit = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
                n_hit = hit[first[1:]] - hit[first[:-1]]
                none = hashlib.sha256(b"").hexdigest()
                sha, n_items = [none] * len(ids), np.zeros(len(ids), np.int64)
                for d, names in items.items():
                    sha[d] = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                    n_items[d] = len(names)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(first)), pa.array(n_hit.astype(np.int64)), pa.array(n_items),
                     pa.array(sha, pa.string()), pa.array(n_hit > 0)], names=schema.names)

        return arrow_map(self.blocks, task, schema)

    def matches(self, slop: int | None = None) -> DataFrame:
        """All matches: id, item_id, kind (``phrase`` or, with ``slop``,
        ``proximity`` for stretches that are not an exact phrase), start (first
        word, from 0) and n_words."""
        store, folder, files = self.store, self.folder, self.files
        schema = fields((self.id_col, self.kind), ("item_id", T.StringType()), ("kind", T.StringType()),
                        ("start", T.LongType()), ("n_words", T.LongType()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, block in _blocks(batches, store):
                for windows in _load(folder, files):
                    for w, terms, offsets in block.find(windows):
                        starts = block.phrases(terms, offsets)
                        spans = np.stack([starts, np.full(len(starts), len(offsets))], axis=1)
                        kinds = ["phrase"] * len(starts)
                        if slop is not None:
                            near = block.near(terms, len(offsets) + slop)
                            near = near[~np.isin(near[:, 0], starts)]
                            spans, kinds = np.concatenate([spans, near]), kinds + ["proximity"] * len(near)
                        if len(spans):
                            yield pa.RecordBatch.from_arrays(
                                [ids.take(pa.array(spans[:, 0] >> 32)),
                                 pa.array([str(windows["ids"][windows["item"][w]])] * len(spans), pa.string()),
                                 pa.array(kinds, pa.string()), pa.array(spans[:, 0] & 0xFFFFFFFF), pa.array(spans[:, 1])],
                                names=schema.names)

        return arrow_map(self.blocks, task, schema).distinct()
