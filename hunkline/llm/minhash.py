"""Near-duplicate detection by circulant MinHash.

Signatures need two permutations only. The first scatters the hashed shingles
over a universe of 2**32 places; coordinate k is the least value of the second
permutation over those places shifted by k, round the universe. Runs of
``ROWS`` coordinates make a band; texts that agree in a band are candidates, and
candidates are confirmed by the exact Jaccard similarity of their full sets.

The job, step by step:

1. Tasks hash whole texts to shingle sets, sketch them, and write id, set hash
   (the node), set size and band keys. Texts with equal sets are one node, so a
   group of copies, however large, is one row from here on.
2. Band keys are counted as sorted runs. Keys of two or more nodes are kept as a
   sorted hash array, against which nodes filter their own bands: only real
   buckets become rows.
3. The sets of nodes in buckets (and no others) are written to the shared folder
   and memory-mapped by the tasks that compare them.
4. Each node is compared with the first node of its buckets; links join nodes to
   components. This is linear, and joins most of a group of near copies.
5. Buckets that still hold several components are compared in full, between
   their different components: in blocks of ``BLOCK`` nodes, two blocks a task,
   so no task holds a whole large bucket. Only links that join components are
   written. No bucket is capped and no candidate dropped.

The chance to miss a pair at a similarity of exactly 0.75 is
(1 - 0.75**5)**48 = 2.3e-6, and less above. Two different sets share a 64-bit set
hash with probability 2**-64.

Defined cases: null texts and texts without a word have an empty set and are
linked with nothing. A text of one to four words has one shingle, the whole
sequence. Rows with equal ids are linked each by its own text; repeated rows give
equal results. A row with a null id takes no part: it has no component (null) and
is kept. Ids must be integers. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkline.llm import store as S
from hunkline.llm.runtime import arrow_map, checkpointed, fields, workdir
from hunkline.llm.textscan import NOT_SPACE, U64, combine, mix64, scan
from hunkline.operators.lookup import lookup

SHINGLE = 5
PERCENT = 75
ROWS = 5
BANDS = 48
BLOCK = 512
SHARD_BYTES = 32 << 20
HOT_ROWS = 20_000       # rows of a join key beyond which it is salted
MOST_SALTS = 256

_LINK = fields(("a", T.LongType()), ("b", T.LongType()))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b, w in scan(column, NOT_SPACE):
        h = combine(w.hashes, size)
        for i in range(b - a):
            first, last = w.first[i], w.first[i + 1]
            if last - first >= size:
                yield np.unique(h[first:last - size + 1])
            elif last > first:
                yield combine(w.hashes[first:last], int(last - first))
            else:
                yield np.zeros(0, U64)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: least values of the second permutation over the places
    that the first gives, shifted by 0, 1, 2, ..."""
    places = (mix64(shingles ^ U64(0x5BD1E9955BD1E995)) >> U64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)
    step = max(1, (1 << 16) // size)
    for at in range(0, len(places), step):
        y = places[at:at + step, None] + shift  # round the universe of 2**32
        y *= np.uint32(0x85EBCA6B)
        y ^= y >> np.uint32(15)
        y *= np.uint32(0xC2B2AE35)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(axis=0), out=out)
    return out


def band_keys(shingles: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    s = signature(shingles, rows * bands).reshape(bands, rows).astype(U64)
    out = np.arange(1, bands + 1, dtype=U64)
    for i in range(rows):
        out = mix64(out * U64(0x9FB21C651E98DF25) + s[:, i])
    return out


def set_hash(shingles: np.ndarray) -> int:
    total = np.array([mix64(shingles).sum(dtype=U64)]) + np.array([len(shingles)], U64) * U64(0xA24BAED4963EE407)
    return int(mix64(total).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the exact Jaccard similarity reaches the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Sets:
    """Reader of the stored sets: ``key``, ``start`` and ``size`` per node, and all
    values of a shard in one array."""

    def __init__(self, store: S.Store) -> None:
        self.store = store

    def of(self, nodes: np.ndarray) -> dict[int, np.ndarray]:
        keys = np.unique(nodes.view(U64))
        got = self.store.lookup(keys, ("start", "size"))
        shards = S.route(keys, self.store.bits, self.store.mixed)
        return {int(k): self.store.array(int(s), "values")[a:a + n] for k, s, a, n in
                zip(keys.view(np.int64), shards, got["start"], got["size"])}


def compare_all(nodes: np.ndarray, labels: np.ndarray, sets: dict[int, np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between nodes of different labels, as many as join their components:
    all intersections at once, as products of the sets' indicator matrix."""
    own = [sets[int(n)] for n in nodes]
    size = np.array([len(x) for x in own])
    if len(nodes) == 2:
        return [(int(nodes[0]), int(nodes[1]))] if labels[0] != labels[1] and linked(*own, percent) else []
    values, place, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(nodes)), size)
    shared = count[place] > 1
    column = (np.cumsum(count > 1) - 1)[place[shared]]
    row = row[shared]
    both = np.zeros((len(nodes), len(nodes)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(1, (4 << 20) // len(nodes))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(nodes), step), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    union = size[:, None] + size - both
    found = np.argwhere(np.triu((100 * both >= percent * union) & (labels[:, None] != labels), 1))
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in found.tolist():
        x, y = top(int(labels[i])), top(int(labels[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=_LINK.names)


def _salted(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of ``many`` with ``one`` (a row a key). Keys with more than
    ``HOT_ROWS`` rows of ``many``, if there are any, get salts on both sides, so
    their rows are spread over tasks."""
    n = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    if (n.agg(F.max("n")).first()[0] or 0) <= HOT_ROWS:
        return many.join(one, key, how)
    hot = checkpointed(n.filter(F.col("n") > HOT_ROWS)
                       .select(key, F.least(F.ceil(F.col("n") / HOT_ROWS), F.lit(MOST_SALTS)).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = lookup(many, hot, key).withColumn("salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int")).drop("salts")
    right = lookup(one, hot, key).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"], how).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes with links; the label is the component's least
    node. Labels spread to neighbours and jump to the label of their label, until
    nothing changes; every round is checkpointed. The centre of a star and the label
    of a large component are join keys of many rows; those are salted."""
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = (_salted(edges, labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        spread = checkpointed(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = checkpointed(_salted(spread, up, "label").select("node", "old", F.least("label", "up").alias("label")))
        moved = new.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _write(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    path = f"file://{workdir(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sketch(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, node, n, bands) of every row; the node of an empty set is null."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, bands = [], [], []
            for s in shingle_sets(batch.column(0)):
                node.append(set_hash(s) if len(s) else None)
                n.append(len(s))
                bands.append(band_keys(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(bands, pa.binary())], names=["id", "node", "n", "bands"])

    return arrow_map(rows, task, fields(("id", T.LongType()), ("node", T.LongType()), ("n", T.LongType()), ("bands", T.BinaryType())))


def _buckets(classes: DataFrame, spark: SparkSession) -> DataFrame:
    """(bucket, node) of all buckets of two or more nodes."""
    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for at in range(0, batch.num_rows, 4096):
            yield np.frombuffer(b"".join(batch.column(0).slice(at, 4096).to_pylist()), U64)

    rows = classes.count()
    several, _ = S.count_keys(classes.select("bands"), S.shard_bits(rows * BANDS * 8), workdir(spark, "bands"), keys, least=2)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = np.frombuffer(b"".join(part.column(0).to_pylist()), U64)
                distinct, place = np.unique(own, return_inverse=True)
                hit = np.flatnonzero((several.lookup(distinct)["id"] >= 0)[place])
                nodes = part.column(1).to_numpy()[hit // BANDS]
                yield pa.RecordBatch.from_arrays([pa.array(own[hit].view(np.int64)), pa.array(nodes)], names=["bucket", "node"])

    return arrow_map(classes.select("bands", "node"), task, fields(("bucket", T.LongType()), ("node", T.LongType())))


def _store_sets(df: DataFrame, id_col: str, text: str, members: DataFrame, spark: SparkSession) -> Sets:
    """Write the sets of the member nodes: texts are found by the id of a node's
    first document, then hashed again."""
    ids = S.save_keys(members.select("first_id"), workdir(spark, "member-ids"))
    nodes = S.save_keys(members.select("node"), workdir(spark, "member-nodes"))
    n_bytes = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8
    bits = max(5, int(np.ceil(np.log2(max(n_bytes / SHARD_BYTES, 1)))))
    folder = workdir(spark, "sets")
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a repeated row is sent once
        for batch in batches:
            own = batch.column(1).fill_null(0).to_numpy().view(U64)
            distinct, place = np.unique(own, return_inverse=True)
            part = batch.column(0).filter(pa.array((ids.lookup(distinct)["id"] >= 0)[place]))
            sets = [s for s in shingle_sets(part) if len(s)]
            keys = np.array([set_hash(s) for s in sets], np.int64).view(U64)
            wanted = set(np.unique(keys)[nodes.lookup(np.unique(keys))["id"] >= 0].tolist())
            out = []
            for k, s in zip(keys.tolist(), sets):
                if k in wanted and k not in seen:
                    seen.add(k)
                    out.append((k, s.tobytes()))
            key = np.array([k for k, _ in out], U64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(S.route(key, bits, False).astype(np.int32)), pa.array(key.view(np.int64)),
                 pa.array([s for _, s in out], pa.binary())], names=["shard", "node", "values"])

    def group(data: pa.Table) -> pa.Table:
        shard = data.column("shard")[0].as_py()
        key, first = np.unique(data.column("node").to_numpy().view(U64), return_index=True)
        values = [np.frombuffer(data.column("values")[int(i)].as_py(), U64) for i in first]
        size = np.array([len(v) for v in values], np.int64)
        S.save(folder, shard, key=key, start=np.cumsum(size) - size, size=size, values=np.concatenate(values))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(key)], pa.int64())})

    written = (arrow_map(rows, task, fields(("shard", T.IntegerType()), ("node", T.LongType()), ("values", T.BinaryType())))
               .groupBy("shard").applyInArrow(group, "shard int, n long").collect())
    sizes = [0] * (1 << bits)
    for r in written:
        sizes[r.shard] = r.n
    return Sets(S.Store(folder, bits, sizes))


def _confirm(pairs: DataFrame, sets: Sets) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                a, b = (whole.column(i).slice(at, 2000).to_numpy() for i in (0, 1))
                own = sets.of(np.concatenate([a, b]))
                yield _links([(x, y) for x, y in zip(a.tolist(), b.tolist()) if linked(own[x], own[y])])

    return arrow_map(pairs, task, _LINK)


def _confirm_groups(groups: DataFrame, sets: Sets) -> DataFrame:
    """``groups`` has an array of (node, label) a row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column(0)[i].values
                nodes, labels = (np.asarray(members.field(c), np.int64) for c in ("node", "label"))
                yield _links(compare_all(nodes, labels, sets.of(nodes)))

    return arrow_map(groups, task, _LINK)


def _unresolved(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of nodes to compare in full: buckets with several components, cut
    into blocks, two blocks a group."""
    rows = (buckets.join(labels, "node", "left")
            .select("bucket", "node", F.coalesce("label", "node").alias("label")))
    mixed = (rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))
             .filter(F.col("lo") != F.col("hi")).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    last = F.col("blocks") - 1
    mine = F.pmod(F.hash("node"), F.col("blocks"))
    other = F.when(last == 0, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), last), mine))
    spread = (_salted(rows, mixed, "bucket").select("bucket", "node", "label", mine.alias("mine"), F.explode(other).alias("other"))
              .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    groups = (spread.groupBy("bucket", "i", "j").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("members")))
    # many bands hold the same nodes; the work follows the square of a group, not its bytes
    return _dealt(groups.filter(F.size("members") > 1).select("members").distinct())


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of few bytes and much work, dealt evenly over all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    rows = _write(sketch(df, id_col, text), spark, "sketch")
    classes = _write(rows.filter(F.col("node").isNotNull()).groupBy("node")
                     .agg(F.min("id").alias("first_id"), F.min("n").alias("n"), F.min("bands").alias("bands")), spark, "classes")
    buckets = checkpointed(_buckets(classes, spark))
    members = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "first_id", "n")
    # a class whose ids are all null has no id to find its text by
    members = checkpointed(members.filter(F.col("first_id").isNotNull()))
    buckets = buckets.join(members.select("node"), "node", "left_semi")
    sets = _store_sets(df, id_col, text, members, spark)
    first = buckets.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = (_salted(buckets, first, "bucket").filter(F.col("node") != F.col("a"))
             .select("a", F.col("node").alias("b")).distinct())
    links = checkpointed(_confirm(_dealt(pairs), sets))
    labels = components(links)
    more = checkpointed(_confirm_groups(_unresolved(buckets, labels), sets))
    labels = components(links.union(more))
    # the least id that a component's nodes, and the rows of those ids, reach
    named = labels.join(classes.select("node", "first_id"), "node")
    least = named.groupBy("label").agg(F.min("first_id").alias("component"))
    of_node = classes.select("node", "first_id").join(_salted(named.select("label", "node"), least, "label").select("node", "component"), "node", "left")
    out = _salted(rows.select("id", "node", "n"), of_node, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "first_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
