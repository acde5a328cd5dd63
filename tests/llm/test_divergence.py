"""The divergence audit against its definition, and the tree's sums against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hunkline.llm import divergence as D
from tests.llm.cases import SCHEMA, documents, prose

CLASH = SCHEMA + ", LANG string, Text string, term string, p0 bigint, a int, salt int, VALUE string"


def f(p, q):
    return (p - q) ** 2 // q


def plain(rows, min_docs=3, top=200):
    """rows: (text, lang, source); rows of the audit by definition."""
    docs = defaultdict(list)
    for text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        docs[lang or "", source or ""].append(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)))
    out = []
    for lang in {g[0] for g in docs}:
        groups = {g[1]: ds for g, ds in docs.items() if g[0] == lang}
        seen = Counter(t for ds in groups.values() for d in ds for t in d)
        kept = [t for t, n in seen.items() if n >= min_docs]
        count = {s: sum(ds, Counter()) for s, ds in groups.items()}
        whole = sum(count.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // total for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in groups:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in groups if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def got(df, **how):
    return sorted(tuple(r) for r in D.audit(df, **how).collect())


def test_equals_definition_on_the_defined_cases(spark):
    rng = random.Random(4)
    words = [prose(i, 1) for i in range(60)]
    rows = documents() + [(i, " ".join(rng.choices(words, k=30)), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None, ""]), 1)
                          for i in range(60)]
    rows += [(100, "1 2 3", "xx", "a", 1), (101, None, "xx", "b", 1), (102, "x y z", "alone", "only", 1)]
    rows = [tuple(r) + (None,) * (9 - len(r)) for r in rows]
    df = spark.createDataFrame([r + ("x", "y", "z", 1, 2, 3, "v") for r in rows], CLASH).repartition(4)
    want = plain([(r[1], r[2], r[3]) for r in rows])
    assert got(df) == want
    assert {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)} <= set(want)
    assert not any(r[0] == "alone" for r in want)
    assert {r[2] for r in want} == {"pair", "term"}
    assert got(df, top_terms=4, task_cells=10, block_items=7) == plain([(r[1], r[2], r[3]) for r in rows], top=4)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("seed", range(5))
def test_tree_adds_each_pair_of_a_row_once(seed, monkeypatch):
    monkeypatch.setattr(D, "COMBINATIONS", 100 if seed else 1_000_000)
    rng = random.Random(seed)
    rows = Counter()
    for _ in range(300):
        path = tuple((s, rng.choice((10, 20, 3_000_000))) for s in range(6) if rng.random() < 0.5)
        if path:
            rows[rng.randrange(2), path] += rng.randint(1, 5)
    base = [3, 5, 7, 2, 9, 4]
    want = Counter()
    for (g, path), m in rows.items():
        for s, p in path:
            for t, q in path:
                if s != t:
                    want[g, s, t] += m * (f(p, q) - f(p, base[t]) - f(base[s], q) + f(base[s], base[t]))
    ordered = sorted(rows)
    offsets = np.concatenate(([0], np.cumsum([len(r[1]) for r in ordered])))
    items = [i for r in ordered for i in r[1]]
    source, p = np.array([i[0] for i in items]), np.array([i[1] for i in items])
    found = Counter()
    args = (np.array([r[0] for r in ordered]), offsets, source, p)
    for g, a, b, value in D.pair_corrections(*args, np.array(base)[source], np.array([rows[r] for r in ordered])):
        for key in zip(g.tolist(), a.tolist(), b.tolist(), value.tolist()):
            found[key[:3]] += key[3]
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in want.items() if v}
    nodes, times = D.tree(*args, np.array([rows[r] for r in ordered]))
    prefixes = Counter()
    for (g, path), m in rows.items():
        for k in range(len(path)):
            prefixes[g, path[:k + 1]] += m
    assert len(nodes) == len(prefixes) and sorted(times.tolist()) == sorted(prefixes.values())
