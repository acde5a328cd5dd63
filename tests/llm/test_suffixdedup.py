"""Repeated byte strings against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hunkline.llm import suffixdedup as D
from tests.llm.cases import SCHEMA, documents, prose

CLASH = SCHEMA + ", DOC_ID string, TEXT string, n_bytes int, gram int, key int"


def plain(rows, length):
    """rows: (id, text); the result by definition."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(t[k:k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if starts[t[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in D.dedup(df, **how).collect()), key=repr)


def spliced(seed, n, passages, size):
    """Texts made of passages, whole or in part, between words of their own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if rng.random() < 0.5 else 0
            b = rng.randrange(a, len(p)) if rng.random() < 0.5 else len(p)
            parts += [prose(rng.randrange(10**9), rng.randint(0, size)), p[a:b]]
        rows.append((i, rng.choice(["", " "]).join(parts)))
    return rows


def test_equals_definition_on_the_defined_cases(spark):
    rows = [tuple(r) + (None,) * (9 - len(r)) for r in documents()]
    rows += [(50, "x" * 900, "en", "s", 1, 0.1, "a", "b", "c"), (51, "ab" * 450 + "é" * 300, "en", "s", 1, 0.1, "a", "b", "c")]
    df = spark.createDataFrame([r + ("x", "y", 1, 2, 3) for r in rows], CLASH).repartition(3)
    want = plain([r[:2] for r in rows], D.LENGTH)
    assert got(df) == want
    assert any(r[2] for r in want) and any(r[2] == 0 for r in want)
    assert got(df.limit(0)) == []


@pytest.mark.parametrize("run_limit, shard_contexts", [(8192, 16384), (8192, 40), (2, 100)])
def test_passages_in_many_places(spark, run_limit, shard_contexts):
    """Through the arrays, through many shards, and with frequent grams counted."""
    passages = [prose(i, 40) for i in range(6)] + [prose(99, 7), "zz" * 60]
    rows = spliced(5, 120, passages, 12)
    rows += [(1000 + i, passages[0]) for i in range(3)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(df, length=40, gram=20, run_limit=run_limit, shard_contexts=shard_contexts) == plain(rows, 40)


def test_production_lengths(spark):
    rows = spliced(6, 60, [prose(i, 200) for i in range(4)] + [prose(77, 90)], 150)
    assert got(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows, 400)


@pytest.mark.parametrize("seed", range(6))
def test_family_in_any_batches(seed, monkeypatch):
    """Levels of any shape mark the same strings."""
    rng = random.Random(seed)
    text = "".join(r[1] for r in spliced(seed, 40, [prose(i, 30) for i in range(4)], 6)).encode()
    data = np.frombuffer(text, np.uint8)
    monkeypatch.setattr(D, "PIECE", rng.choice([1 << 20, 333]))
    found = [(at + c.lo, c.anchor - c.lo, c.anchor - c.hi) for at, c in D.contexts(data, np.array([0, len(data)]), 40, 20)]
    lo, most, least = (np.concatenate(v) for v in zip(*found))
    order = np.array(rng.sample(range(len(lo)), len(lo)))
    lo, most, least = lo[order], most[order], least[order]
    family = D.Family(40, 20)
    at = 0
    while at < len(lo):
        to = at + rng.choice([1, 3, 50, 500])
        family.add(data, lo[at:to], most[at:to], least[at:to], np.ones(len(lo[at:to]), np.int64))
        sizes = [len(x) for x in family.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
        at = to
    starts = Counter(text[k:k + 40] for k in range(len(text) - 39))
    seen = set()
    for i in range(len(lo)):
        for o in range(21):
            inside = least[i] <= o <= most[i]
            k = int(lo[i] + most[i] - o)
            assert family.repeated[i, o] == (inside and starts[text[k:k + 40]] > 1)
            if inside:
                seen.add(k)
    assert seen == set(range(len(text) - 39))
    whole = np.concatenate(family.levels)
    assert sorted(whole.tolist()) == list(range(len(lo)))
    for level in family.levels:
        rows = [family.after[i].tobytes() for i in level]
        assert rows == sorted(rows)
