"""JavaScript string semantics (T1-T12) as Spark expressions."""

from pyspark.sql import functions as F

from conftest import one
from hunkline.functions import (estimate_tokens, js_has_text, js_or, js_replace_first, js_trim,
                                plural, strip_one_quote, utf16_length)


def test_utf16_length_counts_surrogate_pairs(spark):
    assert one(spark, utf16_length(F.col("x")), "a\U0001F600é") == 4
    assert one(spark, utf16_length(F.col("x")), "") == 0


def test_estimate_tokens_exact_ceiling(spark):
    assert one(spark, estimate_tokens(F.col("x")), "a" * 100) == 40
    assert one(spark, estimate_tokens(F.col("x")), "abcdefg") == 3
    assert one(spark, estimate_tokens(F.col("x")), "") == 0
    assert one(spark, estimate_tokens(F.col("x")), "a" * 37500) == 15000
    assert one(spark, estimate_tokens(F.col("x")), "a" * 37501) == 15001
    # two astral characters are four UTF-16 units -> ceil(4 / 2.5) = 2
    assert one(spark, estimate_tokens(F.col("x")), "\U0001F600\U0001F600") == 2


def test_js_trim_whole_unicode_space_set(spark):
    s = " ﻿　 x y \t\r\n "
    assert one(spark, js_trim(F.col("x")), s) == "x y"
    assert one(spark, js_has_text(F.col("x")), " ﻿　") is False
    assert one(spark, js_has_text(F.col("x")), " a ") is True


def test_strip_one_quote_each_end(spark):
    assert one(spark, strip_one_quote(F.col("x")), '""hi"') == '"hi'
    assert one(spark, strip_one_quote(F.col("x")), '"') == ""
    assert one(spark, strip_one_quote(F.col("x")), "'a'") == "a"
    assert one(spark, strip_one_quote(F.col("x")), "a\n\"") == "a\n"


def test_replace_first_only(spark):
    assert one(spark, js_replace_first(F.col("x"), "models/"), "models/a-models/b") == "a-models/b"
    assert one(spark, js_replace_first(F.col("x"), "models/"), "x.models/") == "x."


def test_or_falls_through_empty(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b")], "a STRING, b STRING")
    assert [r[0] for r in df.select(js_or("a", F.col("b"))).collect()] == ["b", "b", "a"]


def test_plural(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "n BIGINT")
    assert [r[0] for r in df.select(plural("n", "file")).collect()] == ["0 files", "1 file", "2 files"]


def test_locale_order_differs_from_binary(spark):
    names = ["Model-A", "gemma-3", "model-10", "model-2.5_x", "model-2.5-flash"]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = [r[0] for r in df.orderBy(F.collate("name", "UNICODE")).collect()]
    assert got[0] == "gemma-3" and got[-1] == "Model-A"
    assert [r[0] for r in df.orderBy("name").collect()][0] == "Model-A"
