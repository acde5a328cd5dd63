"""The Merkle manifest against a plain tree, on the defined cases."""

import hashlib
import zlib

import pytest

from hunkline.llm import manifest as M
from tests.llm.cases import SCHEMA, documents, prose

CLASH = SCHEMA + ", DOC_ID string, Text string, grp string, pos int, N int, digest string, steps string"


def sha(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(levels, i):
    """(is right child, sibling or None) of each level."""
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars, ...)"""
    def leaf(r, add=0):
        return sha(*[field(v) for v in (r[0], r[3], r[2], r[4] if r[4] is None else r[4] + add, r[1])])

    groups = {}
    for r in sorted(rows, key=lambda r: ((r[2] is not None, (r[2] or "").encode()), (r[0] is not None, r[0] or 0), leaf(r))):
        groups.setdefault(r[2], []).append(r)
    trees = {g: tree([leaf(r) for r in rs]) for g, rs in groups.items()}
    top = tree([t[-1][0] for t in trees.values()]) if trees else [[""]]
    out = []
    for k, (g, rs) in enumerate(groups.items()):
        for i, r in enumerate(rs):
            steps = path(trees[g], i) + path(top, k)
            d = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for right, s in steps:
                d = sha(d) if s is None else sha(s, d) if right else sha(d, s)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[s for _, s in steps if s]), d, d == top[-1][0]))
    return sorted(out, key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in M.manifest(df, **how).collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_equals_plain_tree_on_the_defined_cases(spark, height):
    rows = documents() * 2 + [(i, prose(i, 3), "en", None, 1) for i in range(100, 121)] + [(200, "z", "", "s", 1), (201, "", "zz", "s", None)]
    rows = [tuple(r) + (None,) * (9 - len(r)) for r in rows]
    df = spark.createDataFrame([r + ("x", "y", "g", 1, 2, "d", "s") for r in rows], CLASH).repartition(5)
    want = plain(rows)
    assert got(df, height=height) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_small_tables(spark, n):
    rows = [(i, f"t{i}", None, None, None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert got(df, height=1) == got(df) == plain(rows)


def test_many_groups_of_one(spark):
    rows = [(i, "t", f"l{i}", "s", i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert got(df, height=2) == plain(rows)


def test_block_equals_whole_tree():
    """Blocks of any height give the proofs of the whole tree."""
    digests = [sha(str(i)) for i in range(11)]
    whole = M.Block(digests, M.levels(11))
    proofs = whole.proofs("")
    assert len(proofs) == 11 and all(M.fold(d, proofs[i]) == whole.root for i, d in enumerate(digests))
    assert whole.root == tree(digests)[-1][0]
    assert [[s for _, s in M.split_steps(proofs[10]) if s]] == [[s for _, s in path(tree(digests), 10) if s]]
