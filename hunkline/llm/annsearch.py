"""Nearest neighbours by randomly rotated one-bit codes.

Index: vectors are centred, scaled to unit length and turned by one random
rotation; a vector's code is the signs of its coordinates, packed to bits. Beside
it stand two scalars: its distance to the centre and the inner product of the
unit vector with its code. Every row is indexed. Tasks gather rows into blocks
(ids, vectors, codes, scalars), which are rows of a Parquet table in the shared
folder.

Search: an inner product with a query is estimated from the bits and the scalars,
with a bound of its error that holds but for a fraction set by ``ERROR``. For
each block and query the vectors whose least possible distance is not above the
k-th smallest exact distance so far are reranked by exact distance in double
precision. From ``TWO_PASSES`` blocks on, about the square root of their number is
searched first, and the k-th distance found there is where each query starts in all
other blocks, which then give only what is nearer: rows that grow with the
square root of the blocks, not with the blocks. A merge by query keeps the k nearest of
all. There is no list, bucket or cap that a vector could fall out of; what
is approximate is the error bound alone.

Queries are written to the shared folder by tasks, in files of bounded size that
every search task maps and goes through. Only the centre (one vector) reaches
the driver.

Defined cases: null vectors, zero vectors, vectors with a null or non-finite
component, rows with a null id, and vectors whose dimension is not the commonest
one take no part. Rows with the query's id are not its neighbours. Repeated rows
of an id are one neighbour, at its least distance; if rows with a query's id hold
different vectors, the smallest one asks. Ties go to the smaller id. Fewer
candidates than k give as many rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm.runtime import arrow_map, fields, ship, stored, workdir

ERROR = 3.0             # width of the error bound, in standard deviations
BLOCK_ROWS = 65_536
SCAN_ROWS = 8_192       # rows of a block compared at a time
QUERY_ROWS = 128        # queries of one file
TWO_PASSES = 16         # blocks from which the search has two passes
SEED = 11
_INDEX = fields(("ids", T.BinaryType()), ("vectors", T.BinaryType()), ("codes", T.BinaryType()), ("scalars", T.BinaryType()))


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that can take part, whatever their dimension."""
    v = F.col("vector")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0)))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, and the scalars: distance to the centre, inner product with
    the code."""
    away = vectors - centre
    norm = np.linalg.norm(away, axis=1)
    unit = away @ turn / np.where(norm > 0, norm, 1)[:, None]
    inner = np.where(norm > 0, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1]), 1.0)
    return np.packbits(unit > 0, axis=1), np.stack([norm, inner], axis=1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


class Index:
    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> None:
        spark = df.sparkSession
        ship(spark)
        self.rows = usable(df, id_col, vector)
        sizes = self.rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dimension = d = sizes[0].d if sizes else 1
        self.rows = self.rows.filter(F.size("vector") == d)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(d), 0
            for batch in batches:
                total += _matrix(batch.column(0), d).sum(axis=0)
                n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))],
                                             names=["n", "total"])

        parts = arrow_map(self.rows.select("vector"), sums, fields(("n", T.LongType()), ("total", T.ArrayType(T.DoubleType()))))
        mean = parts.select("n", F.posexplode("total")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
        self.centre = np.zeros(d)
        for r in mean:
            self.centre[r.pos] = r.s / max(r.n, 1)
        centre, turn = self.centre, rotation(d)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, held = [], [], 0

            def block() -> pa.RecordBatch:
                x = np.concatenate(vectors)
                codes, scalars = encode(x, centre, turn)
                return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in
                                                   (np.concatenate(ids), x, codes, scalars)], names=_INDEX.names)

            for batch in batches:
                for at in range(0, batch.num_rows, block_rows):
                    part = batch.slice(at, block_rows)
                    ids.append(part.column(0).to_numpy().astype(np.int64))
                    vectors.append(_matrix(part.column(1), d))
                    held += part.num_rows
                    if held >= block_rows:
                        yield block()
                        ids, vectors, held = [], [], 0
            if held:
                yield block()

        self.blocks = stored(arrow_map(self.rows, blocks, _INDEX), "codes")

    def _write_queries(self, queries: DataFrame) -> tuple[str, list[str]]:
        """Files of queries (id, vector, limit), written by tasks, and their names."""
        folder, d = workdir(queries.sparkSession, "queries"), self.dimension

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = []
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    part = batch.slice(at, QUERY_ROWS)
                    path = os.path.join(folder, name := uuid.uuid4().hex + ".npz")
                    with open(path + ".part", "wb") as f:
                        np.savez(f, ids=part.column(0).to_numpy(), vectors=_matrix(part.column(1), d), limit=part.column(2).to_numpy())
                    os.replace(path + ".part", path)
                    names.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

        return folder, [r.name for r in arrow_map(queries, task, fields(("name", T.StringType()))).collect()]

    def _scan(self, blocks: DataFrame, queries: DataFrame, k: int, error: float) -> DataFrame:
        """(query_id, vec_id, score): each block's nearest within the query's limit."""
        folder, files = self._write_queries(queries)
        d, centre, turn = self.dimension, self.centre, rotation(self.dimension)
        schema = fields(("query_id", T.LongType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, vectors, codes, scalars = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in
                                                    zip(_INDEX.names, (np.int64, np.float64, np.uint8, np.float64)))
                    block = (ids, vectors.reshape(-1, d), codes.reshape(len(ids), -1), scalars.reshape(-1, 2))
                    for name in files:
                        with np.load(os.path.join(folder, name)) as f:
                            q, v, s = nearest(block, f["ids"], f["vectors"], centre, turn, k, error, f["limit"])
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=schema.names)

        return arrow_map(blocks, task, schema).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def search(self, asks: Column, k: int = 10, error: float = ERROR) -> DataFrame:
        """The k nearest neighbours of the indexed rows for which ``asks`` (over
        the column ``id``) holds: query_id, rank, vec_id, score."""
        queries = (self.rows.filter(asks).groupBy("id").agg(F.min("vector").alias("vector"))
                   .withColumn("limit", F.lit(float("inf"))))
        by_distance = Window.partitionBy("query_id").orderBy("score", "vec_id")

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= k)

        n = self.blocks.count()
        if n < TWO_PASSES:
            found = self._scan(self.blocks, queries, k, error)
        else:
            few = F.pmod(F.xxhash64("ids"), F.lit(int(np.sqrt(n)))) == 0  # blocks are dealt by their ids
            first = stored(best(self._scan(self.blocks.filter(few), queries, k, error)), "first-pass")
            limits = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("found"))
            queries = (queries.join(limits, "id", "left")
                       .select("id", "vector", F.coalesce("found", "limit").alias("limit")))
            found = (self._scan(self.blocks.filter(~few), queries, k, error).unionByName(first.drop("rank"))
                     .groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
        return best(found).select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed coordinate by coordinate."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        away = vectors[:, j] - query[..., j]
        total += away * away
    return np.sqrt(total)


def nearest(block: tuple[np.ndarray, ...], query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray,
            turn: np.ndarray, k: int, error: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, distance) of the k nearest rows of a block for each query,
    of those at most ``within`` away."""
    ids, vectors, codes, scalars = block
    d = vectors.shape[1]
    away = queries - centre
    asked = np.linalg.norm(away, axis=1)
    unit = (away @ turn / np.where(asked > 0, asked, 1)[:, None]).astype(np.float32)
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in query_ids]
    limit = np.full(len(query_ids), np.inf) if within is None else within.astype(np.float64)

    def rerank(q: int, rows: np.ndarray) -> None:
        rows = rows[ids[rows] != query_ids[q]]
        if not len(rows):
            return
        own = np.concatenate([best[q][0], ids[rows]])
        far = np.concatenate([best[q][1], exact(vectors[rows], queries[q])])
        order = np.lexsort((own, far))
        own, far = own[order], far[order]
        if within is not None:
            own, far = own[far <= within[q]], far[far <= within[q]]
        _, first = np.unique(own, return_index=True)  # an id once, at its least distance
        first = np.sort(first)[:k]
        best[q] = own[first], far[first]
        if len(first) == k:
            limit[q] = min(limit[q], far[first[-1]])

    for at in range(0, len(ids), SCAN_ROWS):
        norm, inner = scalars[at:at + SCAN_ROWS].T
        signs = np.unpackbits(codes[at:at + SCAN_ROWS], axis=1, count=d).astype(np.float32) * 2 - 1
        estimate = (unit @ signs.T) / np.sqrt(d) / inner
        width = error * np.sqrt(np.maximum(1 - inner ** 2, 0)) / inner / np.sqrt(max(d - 1, 1))
        product = np.minimum(estimate + width, 1)  # the most that the inner product can be
        least = norm ** 2 + asked[:, None] ** 2 - 2 * norm * asked[:, None] * product
        for q in np.flatnonzero(np.isinf(limit)):  # no k-th distance yet: the likeliest rows first
            guess = norm ** 2 - 2 * norm * asked[q] * estimate[q]
            rerank(q, at + np.argpartition(guess, min(4 * k, len(guess) - 1))[:4 * k + 1])
        slack = 1e-9 + 1e-5 * asked[:, None] * norm  # the estimates are single precision
        for q, rows in enumerate(least <= limit[:, None] ** 2 + slack):
            rerank(q, at + np.flatnonzero(rows) if not np.isinf(limit[q]) else at + np.arange(len(norm)))
    return (np.repeat(query_ids, [len(b[0]) for b in best]), np.concatenate([b[0] for b in best]),
            np.concatenate([b[1] for b in best]))
