"""Weak labels: EM recovers accuracies, and scores follow the labels."""

import numpy as np

from hunkline.llm import quality
from tests.llm.cases import SCHEMA, documents, prose


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = (rng.random(20_000) < 0.7).astype(int)
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85, 0.6])
    votes = np.where(rng.random((20_000, 6)) < right, truth[:, None], 1 - truth[:, None])
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table = quality.em(patterns, counts.astype(float))
    own = table[:, 1, 1] / (table[:, 1, 1] + table[:, 1, 0])
    assert np.abs(own - right).max() < 0.04
    assert ((posterior[place.ravel()] > 0.5) == truth).mean() > 0.93


def test_scores_and_defined_cases(spark):
    rows = [(i, prose(i, 60) if i % 4 else "$$$ %%% ### " * 30 + "A!! " * 20) for i in range(80)]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].predicted == int(i % 4 != 0) for i in range(80))
    docs = spark.createDataFrame(documents(), SCHEMA)
    edge = quality.score(docs).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert quality.score(docs.limit(0)).count() == 0


def test_a_test_that_good_texts_rarely_fail_is_enough():
    """Two kinds of bad texts fail tests 0 and 1 together, or, more often than good
    texts may, test 2 alone."""
    patterns = np.array([[1, 1, 1], [0, 0, 1], [1, 1, 0]])
    counts = np.array([820.0, 60.0, 120.0])
    free, _ = quality.em(patterns, counts)
    posterior, table = quality.em(patterns, counts, false_alarm=0.01)
    assert free[2] > 0.5 and posterior[2] < 0.5
    assert posterior[0] > 0.9 and posterior[1] < 0.1
    assert table[:, 1, 0].max() <= 0.01 and np.allclose(table.sum(axis=2), 1)


def test_echo_sees_repeats_only():
    line = lambda s: np.frombuffer(s.encode(), np.uint8)
    assert quality._echo(line("word " * 40)) >= 9
    assert quality._echo(line(prose(3, 60))) <= 3
    assert quality._echo(line("")) == quality._echo(line("a")) == 0


def test_one_long_text_does_not_take_the_sample(spark):
    rows = [(i, prose(i, 60) if i % 4 else "$$$ %%% ### " * 30 + "A!! " * 20) for i in range(80)]
    schema = "doc_id bigint, text string"
    alone = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, schema)).collect()}
    long = [(1000 + i, prose(1, 2000) * 300) for i in range(6)]  # about 3 MB each
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(long + rows, schema)).collect()}
    assert len(got) == 86 and max(abs(got[i] - alone[i]) for i in alone) < 0.1
