import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparcel.llm import toxicity as T

DOCS = "doc_id long, text string, toxicity string"


@pytest.fixture(scope="module")
def model():
    return T.Model({"scum": 8.0, "fool": 3.0}, -6.0, 0.1)


def brute(text, model):
    clean = 1.0
    for start, end, words in T.sentences(text):
        clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(w, 0) for w in words))))
    return 1 - clean


ROWS = [(1, None), (2, ""), (3, " .!?\n"), (4, "A day. You SCUM! Bye"), (5, "fool fool. fool"), (None, "scum"), (6, "word " * 200_000 + "scum"), (6, "word " * 200_000 + "scum")]


def test_scores_and_spans(spark, model):
    got = T.score_toxicity(spark.createDataFrame([(*r, "x") for r in ROWS], DOCS), model, "t").collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.t.score == pytest.approx(brute(r.text, model), abs=1e-9)
        for s in r.t.offending:
            assert "scum" in r.text[s.start : s.end].lower()
    assert [r.t.score for r in got[:3]] == [0, 0, 0]
    assert [(s.start, s.end) for s in got[3].t.offending] == [(6, 15)]


def test_drop(spark, model):
    kept = T.drop_toxic(spark.createDataFrame([(*r, "x") for r in ROWS], DOCS), model)
    assert kept.columns == ["doc_id", "text", "toxicity"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]


def test_noisy_or_finds_the_words():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for _ in range(600):
        doc = [list(map(int, rng.choice(20, 3, replace=False) + 2)) for _ in range(rng.integers(1, 6))]
        bad = rng.random() < 0.3
        if bad:
            doc[rng.integers(len(doc))].append(int(rng.integers(2)))
        bags.append(doc)
        labels.append(bad)
    theta = T.fit_bags(bags, np.ones(600), np.array(labels), 22)
    assert theta[:2].min() > theta[2:-1].max() + 3
    assert theta[:2].min() + theta[-1] > 0 > theta[-1]


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(4, 0)], 0.0), ([(4, 1)], 1.0), ([(None, 1), (4, None)], 0.0)])
def test_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], DOCS)
    fitted = T.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert fitted.bias is None and fitted.share == score
    assert {r.t.score for r in T.score_toxicity(docs, fitted, "t").collect()} == {score}


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert T.drop_toxic(docs, T.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.queries()["op1_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.96
    assert np.mean([y for p, y in held if p]) > 0.95


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_many_toxic_labels(spark, share):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < share
        parts = [" ".join(rng.choice(plain, 6)) for _ in range(rng.integers(2, 4) if toxic else rng.integers(2, 30))]
        if toxic:
            parts[rng.integers(len(parts))] += " " + str(rng.choice(["scum", "vermin"]))
        rows.append((i, ". ".join(parts), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, DOCS)
    model = T.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False))
    assert {"scum", "vermin"} <= set(model.weights)
    for r in T.score_toxicity(docs, model, "t").collect():
        assert (r.t.score >= 0.5) == bool(labels[r.doc_id][1])
        assert all("scum" in r.text[s.start : s.end] or "vermin" in r.text[s.start : s.end] for s in r.t.offending)
