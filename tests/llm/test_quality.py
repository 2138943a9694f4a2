import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from sparcel.llm import quality as Q

DOCS = "doc_id long, text string, quality_score string"
ROWS = [(1, None), (2, ""), (3, "A day\nA day"), (3, "A day\nA day"), (None, "WORDS!! WORDS!!"), (4, "word " * 300_000)]


def test_ngrams():
    words, shapes = Q.ngrams("Ab ab, CD 1\n\n!!!!!!")
    assert words == {"ab", ",", "cd", "1", "\n", "!!!!!!"}
    assert ("Aa", "a") in shapes and ("A", "0", "\n") in shapes and ("\n", "=", "!!!!") in shapes
    assert Q.ngrams(None) == (set(), set())


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(8) < 0.5) for _ in range(60)]
    labels = np.array([int(0 in r) ^ int(rng.random() < 0.1) for r in rows])
    ratio = rng.normal(size=8)
    weight, bias = Q.dual_coordinate_descent(rows, labels, ratio, cost=0.5, passes=2000)
    x = np.zeros((60, 9))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r]
    x[:, 8] = 1
    sign = np.where(labels > 0, 1, -1)

    def loss(w):
        return w @ w / 2 + 0.5 * np.maximum(0, 1 - sign * (x @ w)).sum()

    ours = np.append(np.divide(weight, ratio), bias)
    for _ in range(3000):
        assert loss(ours) <= loss(ours + rng.normal(size=9) * rng.choice([1e-3, 1e-2, 0.1])) + 1e-6


def test_ratio():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    ratio = Q.log_count_ratio(rows, np.array([1, 1, 0]), 3)
    assert ratio == pytest.approx(np.log([2 / 6, 3 / 6, 1 / 6]) - np.log([1 / 4, 1 / 4, 2 / 4]))


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(3, 0)], 0.0), ([(3, 1)], 1.0), ([(None, 1), (4, None)], 0.0)])
def test_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], DOCS)
    model = Q.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"), held_out=Q.F.lit(False))
    assert {r.q for r in Q.score_quality(docs, model, "q").collect()} == {score}


def test_edges(spark):
    model = Q.Model({"word": 1.0}, {("a", "="): -0.5, ("a", "=", "="): 0.25}, -2.0, 2.0, 0.5, 0.5)
    got = Q.score_quality(spark.createDataFrame([(*r, "x") for r in ROWS], DOCS), model, "q").collect()
    assert len(got) == len(ROWS)
    for r in got:
        margin = -2 + (0.75 if r.doc_id == 4 else 0)
        assert r.q == pytest.approx(1 / (1 + np.exp(-(2 * margin + 0.5))))
    assert Q.score_quality(spark.createDataFrame([], DOCS), model, "q").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.queries()["op4_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.98
