import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparcel.llm import language_model as L

DOCS = "doc_id long, text string, words string"
ROWS = [(1, "Good day good day"), (2, "bad Day,bad"), (3, None), (4, " .,\n"), (1, "Good day good day"), (None, "good"), (5, "good " * 100_000), (6, "unseen words")]
LABELS = [(1, 1), (2, 0), (5, 1), (5, 1), (5, 0), (6, None), (None, 1), (9, 1)]


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(rows, target):
    words, pairs = ({k: Counter() for k in "tb"} for _ in range(2))
    for doc, text in rows:
        seen = ["<s>", *words_of(text)]
        for k in "tb" if doc in target else "b":
            words[k].update(seen[1:] + (seen[:1] if len(seen) > 1 else []))
            pairs[k].update(zip(seen, seen[1:]))
    out, size = [], 1 + len(set(words["b"]) - {"<s>"})
    for doc, text in rows:
        seen = ["<s>", *words_of(text)]
        loss = {}
        for k in "tb":
            total = sum(words[k].values())
            loss[k] = sum(
                -math.log((pairs[k][v, w] + L.WEIGHT * (words[k][w] + L.FLOOR) / (total + L.FLOOR * size)) / (words[k][v] + L.WEIGHT)) for v, w in zip(seen, seen[1:])
            ) / max(1, len(seen) - 1)
        out.append((doc, len(seen) - 1, round(loss["t"], 4), round(loss["b"], 4)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], DOCS)
    got = L.cross_entropy_difference(docs, spark.createDataFrame(LABELS, "doc_id long, quality int")).collect()
    assert sorted(((r.doc_id, r.lm.n_tokens, round(r.lm.target_loss, 4), round(r.lm.background_loss, 4)) for r in got), key=repr) == brute(ROWS, {1, 5})
    assert all(r.lm.score == pytest.approx(r.lm.target_loss - r.lm.background_loss) for r in got)
    assert {r.lm.score for r in got if r.doc_id in (3, 4)} == {0}


def test_without_target(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], DOCS)
    got = L.cross_entropy_difference(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r.lm.target_loss for r in got if r.doc_id == 6] == pytest.approx([math.log(6)], abs=1e-9)
    assert L.cross_entropy_difference(docs.limit(0), spark.createDataFrame(LABELS, "doc_id long, quality int")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    want = {d: (n, t - b) for d, n, t, b in brute(docs, target)}
    got = {r.doc_id: (r.n_tokens, r.score) for r in entry.queries()["op9_lm"](spark, sf).collect()}
    assert {d: n for d, (n, _) in got.items()} == {d: n for d, (n, _) in want.items()}
    # buckets join some words, so the losses are close, not equal
    assert np.corrcoef([got[d][1] for d in want], [want[d][1] for d in want])[0, 1] > 0.97
    assert np.mean([got[d][1] for d in target]) < np.mean([got[d][1] for d in got if d not in target])


def test_every_word_and_pair_has_its_own_count(spark):
    sf = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in entry.queries()["op9_lm"](spark, sf).collect()), key=repr)
    want = brute(docs, target)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.abs(np.array([g[2:] for g in got]) - [w[2:] for w in want]).max() < 1e-4


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.int64, np.uint64):
        for most in (1, 200, 70_000, 2**31):
            for n in (0, 1, 1000):
                numbers = rng.integers(0, most, n).astype(kind)
                assert (L.unpack(L.pack(numbers), kind) == numbers).all() and len(L.pack(numbers)) <= 1 + n * 4
    assert L.unpack(L.pack(np.array([2**64 - 2, 3], np.uint64)), np.uint64).tolist() == [2**64 - 2, 3]


def test_no_block_is_larger(spark, monkeypatch):
    for size, texts in ((1 << 18, ["word " * 4000] * 150), (1 << 18, ["a b c " * 300_000]), (7, ["a b c d e f g h i j k l m n o p", None, "a", "", "a b c"] * 9)):
        monkeypatch.setattr(L, "BLOCK", size)
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        rows = L.block_texts(docs).select("n_tokens", F.size("rows").alias("n"), F.array_min("lengths").alias("least")).collect()
        assert max(r.n_tokens for r in rows) <= size and sum(r.n_tokens for r in rows) == sum(len((t or "").split()) for t in texts)


def test_clashing_name(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, LM int")
    with pytest.raises(ValueError, match="already"):
        L.cross_entropy_difference(docs, spark.createDataFrame(LABELS, "doc_id long, quality int"))
    assert L.cross_entropy_difference(docs, spark.createDataFrame(LABELS, "doc_id long, quality int"), "loss").columns == ["doc_id", "text", "LM", "loss"]


def test_blocks_and_buckets_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 3)
    monkeypatch.setattr(L, "BUCKET", 500)
    test_against_brute_force(spark)
