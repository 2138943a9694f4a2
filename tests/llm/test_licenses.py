import re

import numpy as np
import pytest

import __spark_entry__ as entry
from sparcel.llm import licenses as L


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, templates):
    found, doc = {}, grams(text)
    for name, template in templates.items():
        own = set(grams(template))
        size = 1 << (len(own) - 1).bit_length()
        for at in range(0, len(doc), size):
            share = len(own & set(doc[at : at + 2 * size])) / len(own)
            if share >= 0.8 - 1e-9 and share > found.get(name, (0,))[0]:
                found[name] = (share, at)
    return [(n, pytest.approx(s), at) for n, (s, at) in sorted(found.items())]


def noisy(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.integers(len(w))] = "changed"
    return " ".join(w)


def test_miss_probability():
    assert L.miss_probability() < 1e-7


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    filler = ["lorem", "ipsum", "under", "the", "license", "software"]
    texts = [None, "", "the mit license", "Released under the MIT License", L.TEMPLATES["mit"].upper()]
    for name, template in L.TEMPLATES.items():
        for edits in (0, 0, 1, 2, 4):
            before, after = (" ".join(rng.choice(filler, rng.integers(0, 80))) for _ in range(2))
            texts.append(f"{before}\n* {noisy(rng, template, edits)}\n{after}")
    texts.append("\n".join(L.TEMPLATES.values()))
    texts.append("word " * 100_000 + L.TEMPLATES["bsd"] + " word" * 100_000)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y"), (None, texts[3], "z")], "doc_id long, text string, shingles string")
    got = L.scan_licenses(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert [tuple(m) for m in r.licenses] == brute(r.text, L.TEMPLATES), r.text
    assert {m.license for r in got for m in r.licenses} == set(L.TEMPLATES)


def test_empty_and_short_templates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan_licenses(docs).count() == 0
    with pytest.raises(ValueError):
        L.scan_licenses(docs, {"short": "all rights reserved"})


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entry.queries()["op3_licenses"](spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        want = brute(t, L.TEMPLATES)
        assert got[i].licenses == ",".join(n for n, _, _ in want) and got[i].n_licenses == len(want)
    assert sum(r.n_licenses for r in got.values()) > 10


def test_no_python_in_the_plan(spark, sf_dir):
    assert not re.search("Python|Pandas|Arrow", entry.queries()["op3_licenses"](spark, sf_dir)._jdf.queryExecution().toString())
