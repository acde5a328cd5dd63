"""Divergence of sources within their language, over a frequent-pattern tree.

For every pair of a language's sources the audit sums a term's divergence
``f(p, q) = floor((p - q)**2 / q)`` over all kept terms, where p and q are the
sources' smoothed shares. Few sources use a given term, so the sum is the value of a
term that nobody uses, times the number of terms, plus corrections:

1. Term counts by (language, source) are summed inside the tasks that read the
   texts, then by Spark. Terms in too few documents of a language go.
2. A kept term is a row of its non-zero counts, sources in the order of their
   number of words (the most frequent first). Equal rows are one row with a multiplicity.
3. The rows are range-partitioned in order, so rows that share a path lie
   together, and each task inserts blocks of them into a tree: rows share the nodes
   of their common prefix, and a node's multiplicity counts the terms below it.
   Each combination of a node and an ancestor adds one correction to the pair of
   their sources, times the node's multiplicity: ``f(p, q) - f(p, q0) - f(p0, q) +
   f(p0, q0)`` (0: the share of an unused term). Blocks add up, however rows fall.
4. What one source's count alone adds, to every other source, comes from how
   many terms have that count there.
5. Sums are exact: shares by decimal division, corrections in 64-bit integers,
   their sums in decimals.

A term is one row for a language, with at most as many counts as the language has
sources; a source that holds a third of all rows is one count in each. Nothing
is sent to the driver; the table of sources is broadcast only up to a counted size.

Defined cases: a null text has no terms; a null language or source is the empty
one. Repeated rows are documents of their own. A group without terms, and a
language without kept terms, still have their pairs. A source alone in its language
has none. Other columns are ignored and cannot clash. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hunkline.llm.runtime import arrow_map, fields, stored, take
from hunkline.llm.store import summed
from hunkline.llm.textscan import LETTERS, LOWER, U64, Words, buffers, steps
from hunkline.operators.lookup import lookup

MIN_DOCS = 3               # documents of a language that a kept term occurs in
TOP_TERMS = 200            # ranks of part ``term``
SCALE = 1_000_000_000
TASK_CELLS = 300_000       # counts that a reading task gathers before it hands them over
BLOCK_ITEMS = 400_000      # counts of a tree
COMBINATIONS = 1_000_000   # node-ancestor combinations of one vectorised step


# --- counts ---------------------------------------------------------------

class _Cells:
    """Counts by (group, term) of one task: uses and documents."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.keys = np.zeros(0, U64), np.zeros(0, np.int64)  # term hash, group
        self.counts = np.zeros((0, 2), np.int64)
        self.terms, self.names = np.zeros(0, U64), pa.array([], pa.large_binary())

    def add(self, words: Words, data: np.ndarray, group_of: np.ndarray) -> None:
        """Words of consecutive texts; ``group_of`` gives each text's group."""
        if not len(words):
            return
        terms, first, code = np.unique(words.hashes, return_index=True, return_inverse=True)
        by_text, uses = np.unique(words.text_of() * len(terms) + code, return_counts=True)
        key, value = summed(group_of[by_text // len(terms)] * len(terms) + by_text % len(terms),
                            np.stack([uses, np.ones_like(uses)], axis=1))
        self._merge(terms[key % len(terms)], key // len(terms), value)
        at = np.concatenate(([0], np.cumsum(words.ends[first] - words.starts[first])))
        place = np.arange(at[-1]) - np.repeat(at[:-1] - words.starts[first], np.diff(at))
        names = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[place])])
        self.terms, kept = np.unique(np.concatenate([self.terms, terms]), return_index=True)
        self.names = pa.concat_arrays([self.names, names]).take(pa.array(kept))

    def _merge(self, terms: np.ndarray, groups: np.ndarray, counts: np.ndarray) -> None:
        terms, groups = np.concatenate([self.keys[0], terms]), np.concatenate([self.keys[1], groups])
        counts = np.concatenate([self.counts, counts])
        order = np.lexsort((groups, terms))
        terms, groups, counts = terms[order], groups[order], counts[order]
        new = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (groups[1:] != groups[:-1]))))
        self.keys, self.counts = (terms[new], groups[new]), np.add.reduceat(counts, new, axis=0)

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def batch(self, names: list[str]) -> pa.RecordBatch:
        groups = list(self.groups)
        of = pa.array(self.keys[1])
        out = pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in groups], pa.string()).take(of), pa.array([g[1] for g in groups], pa.string()).take(of),
             self.names.take(pa.array(np.searchsorted(self.terms, self.keys[0]))).cast(pa.large_string()).cast(pa.string()),
             pa.array(self.counts[:, 0]), pa.array(self.counts[:, 1])], names=names)
        self.clear()
        return out


def term_counts(rows: DataFrame, task_cells: int = TASK_CELLS) -> DataFrame:
    """(lang, source, term, n, docs) of ``rows`` (lang, source, text)."""
    schema = fields(*[(c, "string") for c in ("lang", "source", "term")], ("n", "long"), ("docs", "long"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells()
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in steps(offsets):
                part = LOWER[data[offsets[a]:offsets[b]]]
                group_of = np.array([cells.group(*g) for g in zip(langs[a:b], sources[a:b])], np.int64)
                cells.add(Words(part, offsets[a:b + 1] - offsets[a], LETTERS), part, group_of)
                if len(cells.counts) >= task_cells:
                    yield cells.batch(schema.names)
        if len(cells.counts):
            yield cells.batch(schema.names)

    return (arrow_map(rows, task, schema).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


# --- the tree -------------------------------------------------------------

def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def tree(tree_of: np.ndarray, offsets: np.ndarray, source: np.ndarray, p: np.ndarray, multiplicity: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the trees of ordered rows: (a place among the items where the
    node's path stands, the node's multiplicity). Row i belongs to tree
    ``tree_of[i]`` and has the items from ``offsets[i]``."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    depth = np.arange(len(row)) - offsets[row]
    before = np.maximum(row - 1, 0)
    other = np.minimum(offsets[before] + depth, len(row) - 1)
    same = ((row > 0) & (depth < size[before]) & (tree_of[row] == tree_of[before])
            & (source == source[other]) & (p == p[other]))
    shared = np.minimum.reduceat(np.where(same, len(row), depth), offsets[:-1])  # depth of the common prefix
    order = np.argsort(depth, kind="stable")
    starts = np.flatnonzero((depth >= shared[row])[order])
    return order[starts], np.add.reduceat(multiplicity[row][order], starts)


def pair_corrections(tree_of: np.ndarray, offsets: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray,
                     multiplicity: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(tree, source of p, source of q, sum) over the combinations of nodes with
    their ancestors."""
    nodes, times = tree(tree_of, offsets, source, p, multiplicity)
    first = offsets[np.searchsorted(offsets, nodes, side="right") - 1]
    deep = nodes > first
    nodes, times, first = nodes[deep], times[deep], first[deep]
    tree_at = tree_of[np.searchsorted(offsets, nodes, side="right") - 1]
    ends = np.cumsum(nodes - first)
    wide = int(source.max()) + 1 if len(source) else 1
    at = 0
    while at < len(nodes):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMBINATIONS, side="right")), at + 1)
        count = nodes[at:to] - first[at:to]
        which = np.repeat(np.arange(at, to), count)
        s = nodes[which]
        t = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        sums = []
        for x, y in ((s, t), (t, s)):
            value = times[which] * (_f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y]))
            sums.append(summed((tree_at[which] * wide + source[x]) * wide + source[y], value))
        key, value = summed(*(np.concatenate(v) for v in zip(*sums)))
        yield key // wide // wide, key // wide % wide, key % wide, value
        at = to


def tree_corrections(rows: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(lang, a, b, value) partial sums over ``rows`` (lang, path, m), where a path
    is an ordered array of (a: source number, p, p0)."""
    ordered = rows.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    schema = fields(("lang", "string"), ("a", "integer"), ("b", "integer"), ("value", "long"))

    def block(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks()
        lang = whole.column("lang").chunk(0).dictionary_encode()
        path = whole.column("path").chunk(0)
        items, offsets = path.flatten(), path.offsets.to_numpy()
        a, p, p0 = (items.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        of = lang.indices.to_numpy().astype(np.int64)
        for g, x, y, value in pair_corrections(of, offsets.astype(np.int64) - offsets[0], a, p, p0, whole.column("m").to_numpy()):
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(g)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)),
                                              pa.array(value)], names=schema.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                held += len(batch.column(1).flatten())
            if held >= block_items:
                yield from block(parts)
                parts, held = [], 0
        if parts:
            yield from block(parts)

    return arrow_map(ordered.select("lang", "path", "m"), task, schema)


# --- the audit ------------------------------------------------------------

def _share(n: Column | int, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly."""
    scaled = (F.lit(n) if isinstance(n, int) else n).cast("decimal(20,0)") + 1
    total = F.greatest(total, F.lit(1)).cast("decimal(20,0)")
    return F.call_function("div", scaled * F.lit(SCALE), total) + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top_terms: int = TOP_TERMS, task_cells: int = TASK_CELLS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` for each other source of
    the language, ``term`` for the terms that the source uses more than its language."""
    rows = take(df, lang, source, text).toDF("lang", "source", "text")
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])
    # a term's counts come together: at most one a source
    kept = stored(term_counts(rows, task_cells).groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs).select(F.monotonically_increasing_id().alias("tid"), "lang", "term", "n_lang", "cells"), "terms")
    cells = kept.select("tid", "lang", "term", "n_lang", F.inline("cells"))
    used = cells.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("lang_words"))
    groups = (rows.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["words", "v", "lang_words"]))
    by_words = Window.partitionBy("lang").orderBy(F.col("words").desc(), "source")  # a row per source
    groups = stored(groups.withColumn("a", F.row_number().over(by_words) - 1)
                    .withColumn("p0", _share(0, F.col("words") + F.col("v"))), "sources")

    shares = lookup(cells, groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("words") + F.col("v")))
    q = _share(F.col("n_lang"), F.col("lang_words") + F.col("v"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (shares.withColumn("q", q).filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms))

    paths = (shares.groupBy("lang", "tid").agg(F.sort_array(F.collect_list(F.struct("a", "p", "p0"))).alias("path"))
             .groupBy("lang", "path").agg(F.count("*").alias("m")))
    exact = F.col("value").cast("decimal(38,0)")
    shared = tree_corrections(paths, block_items).groupBy("lang", "a", "b").agg(F.sum(exact).alias("value"))
    # what a count alone adds, by how many terms have it
    alone = shares.groupBy("lang", "a", "p", "p0").agg(F.count("*").alias("m"))
    others = groups.select("lang", F.col("a").alias("b"), F.col("p0").alias("q0"))
    ours = _salted_pairs(alone, others).filter(F.col("a") != F.col("b"))
    both = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), (
        F.col("m") * (_value(F.col("p"), F.col("q0")) - _value(F.col("p0"), F.col("q0"))).cast("decimal(20,0)")).alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), (
            F.col("m") * (_value(F.col("q0"), F.col("p")) - _value(F.col("q0"), F.col("p0"))).cast("decimal(20,0)")).alias("value")))
    single = ours.select("lang", F.inline(both)).groupBy("lang", "a", "b").agg(F.sum(exact).alias("value"))
    named = groups.select("lang", F.col("a").alias("b"), F.col("p0").alias("q0"), F.col("source").alias("item"))
    unused = (_salted_pairs(groups.select("lang", "source", "a", "p0", "v"), named).filter(F.col("a") != F.col("b")).select(
        "lang", "a", "b", "source", "item", (F.col("v") * _value(F.col("p0"), F.col("q0")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("value")))
    # the pairs carry their names; the corrections add to them by number
    parts = (unused.unionByName(shared, allowMissingColumns=True).unionByName(single, allowMissingColumns=True)
             .groupBy("lang", "a", "b").agg(F.max("source").alias("source"), F.max("item").alias("item"), F.sum(exact).alias("value")))
    pairs = (parts.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"))
             .withColumn("rank", F.row_number().over(ranked)))
    return pairs.unionByName(terms)


def _salted_pairs(left: DataFrame, right: DataFrame, salts: int = 16) -> DataFrame:
    """Rows of ``left`` with every source of their language (``right``): as many pairs
    as the audit reports, for each distinct count. A language's rows go to ``salts`` tasks."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    spread = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("salt", salt).join(spread, ["lang", "salt"]).drop("salt")
