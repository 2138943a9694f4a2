import numpy as np
import pytest

import __spark_entry__ as entry
from sparcel.llm import decontaminate as D


def distance_to_part(pattern, text):
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        for j, t in enumerate(text):
            new[j + 1] = min(row[j] + (c != t), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row.min())


def brute(text, index):
    text = D.normal(text)
    found = {i for i, s in index.short if f" {s} " in f" {text} "}
    for item, codes, most in zip(index.items, index.codes, index.edits):
        if distance_to_part("".join(map(chr, codes)), text) <= most:
            found.add(item)
    return found


def noise(rng, n):
    return " ".join("".join(rng.choice(list("abcdeth"), rng.integers(1, 7))) for _ in range(n))


def test_against_brute_force():
    rng = np.random.default_rng(5)
    items = [(i, noise(rng, n)) for i, n in enumerate([5, 12, 25, 60, 2, 1, 40, 40])] + [(90, "ab c"), (91, None), (92, " "), (93, "ab c")]
    index = D.build(items)
    texts = [None, "", "ab c", "xab c", noise(rng, 50)]
    for i, text in items[:8]:
        for edits in (0, 1, 3, 6, 9, 14, 30):
            s = list(text.upper())
            for _ in range(edits):
                at = rng.integers(len(s))
                s[at] = rng.choice(["", "zz", "y"])
            texts.append(noise(rng, 5) + " \n " + "".join(s) + "  " + noise(rng, 5))
        texts.append(text[: len(text) // 2])
        texts.append(text)
    got = D.matches(texts, index)
    assert [set(m) for m in got] == [brute(t, index) for t in texts]
    assert sum(map(bool, got)) > 20


def test_long_text_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    item = noise(rng, 40)
    index = D.build([(1, item)])
    text = noise(rng, 300) + " " + item + " " + noise(rng, 300)
    monkeypatch.setattr(D, "PIECE", 300)
    (got,) = D.matches([text], index)
    assert got[1][0] == 0 and D.normal(text)[: got[1][1]].endswith(D.normal(item)[: D.WINDOW][-20:])


def test_edges_and_drop(spark):
    rng = np.random.default_rng(7)
    item = noise(rng, 30)
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, f"x {item} y", "c"), (3, f"x {item} y", "c"), (None, item, None), (4, "clean text", "d")], "doc_id long, text string, leaks string"
    )
    bench = spark.createDataFrame([(1, item), (2, item), (None, "clean text"), (3, None)], "item_id long, text string")
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [1, 2, 4]
    found = {r.doc_id: [x.item_id for x in r.found] for r in D.find_contamination(docs, bench, "found").collect()}
    assert found == {1: [], 2: [], 3: [1, 2], None: [1, 2], 4: []}
    assert D.drop_contaminated(docs, bench.limit(0)).count() == 6
    assert D.drop_contaminated(docs.limit(0), bench).count() == 0


def test_bound(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST", 5)
    with pytest.raises(ValueError):
        D.read_benchmark(spark.createDataFrame([(1, "too long")], "item_id long, text string"))


def test_planted_items(spark, sf_dir):
    got = {r.doc_id: r.item_ids for r in entry.queries()["op6_decontaminate"](spark, sf_dir).collect()}
    items = [(r.item_id, D.normal(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        exact = {i for i, t in items if t in D.normal(r.text)}
        hits += len(exact)
        assert {str(i) for i in exact} <= set(got[r.doc_id].split(","))
    assert hits


def test_larger_benchmark_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [noise(rng, n) for n in (30, 120, 30, 250)]
    bench = spark.createDataFrame([*enumerate(items), (4, items[0]), (5, "ab c"), (None, "x"), (6, None)], "item_id long, text string")
    texts = [None, "", *items, items[3][:700], f"x {items[0]} y ab c {items[2]}", f"x {items[0]} y ab c {items[2]}", "clean text"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, leaks string")
    found = lambda: sorted(map(repr, D.find_contamination(docs, bench, "found").collect()))
    whole = found()
    monkeypatch.setattr(D, "MOST", 300)
    assert len(list(D.read_blocks(bench))) > 5
    assert found() == whole
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [0, 1, 9]
