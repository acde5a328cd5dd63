"""The header fast path equals the reference regex on random lines."""

import random
import re

from pyspark.sql import functions as F

from hunkline.operators.parse import header_paths

# JavaScript /a\/(.*?) b\/(.*?)$/ without the m flag: '.' excludes line terminators.
JS_HEADER = re.compile(r"a/([^\n\r\u2028\u2029]*?) b/([^\n\r\u2028\u2029]*?)\Z")
ALPHABET = ["a", "b", "/", " ", "x", "a/", " b/", "\r", "\u2028", "é", "\U0001F600"]


def expected(line):
    m = JS_HEADER.search(line)
    return (m.group(1), m.group(2)) if m else ("", "")


def test_fast_path_matches_regex(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    lines += ["a/x b/y b/x b/y", "a/ b/", "xa/ya b/z", "a/b/ b/c", "x b/y a/p b/q", "a/p b/q\r"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i INT, line STRING")
    old, new = header_paths(F.col("line"))
    got = {r.i: (r.o, r.n) for r in df.select("i", old.alias("o"), new.alias("n")).collect()}
    bad = [(lines[i], got[i], expected(lines[i])) for i in range(len(lines)) if got[i] != expected(lines[i])]
    assert not bad, bad[:5]
