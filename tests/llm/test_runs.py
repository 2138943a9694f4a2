import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sparcel.llm import runs
from sparcel.llm.queries import QUERIES


def brute(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p), p)
            i += i == start
    return sorted((s, e - s, p) for (s, e), p in found.items())


def kept(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 20])
        words = [chr(97 + rng.randrange(letters)) for _ in range(n)]
        for _ in range(rng.choice([0, 3]) if n > 12 else 0):
            p, s, size = rng.randint(1, n // 6), rng.randrange(n), rng.randint(1, n)
            for i in range(s + p, min(n, s + size)):
                words[i] = words[i - p]
        yield words


def test_against_brute_force(monkeypatch):
    cases = list(texts(1, 1500))
    for pairs in (runs.PAIRS, 50):
        monkeypatch.setattr(runs, "PAIRS", pairs)
        got = runs.runs_of([[w.encode() for w in words] for words in cases])
        for words, found in zip(cases, got, strict=True):
            assert [tuple(map(int, r)) for r in found] == brute(words)


def test_extensions_both_ways():
    rng = np.random.default_rng(4)
    symbols = np.concatenate(([0], 2 + rng.integers(0, 2, 400), [1]))
    symbols[100:300] = np.tile(symbols[100:107], 29)[:200]
    levels = runs.compress(symbols, 2)
    assert len(levels[-1].symbols) == 3
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, 401, 3), np.arange(1, 401)))
    i, j = i[i != j], j[i != j]
    for step in (1, -1):
        for a, b, n in zip(i, j, runs.extensions(levels, i, j, step)):
            assert (symbols[a : a + n * step : step] == symbols[b : b + n * step : step]).all() and symbols[a + n * step] != symbols[b + n * step]


def test_levels_are_few():
    rng = np.random.default_rng(6)
    for n in (2, 3, 1000, 60000):
        assert len(runs.compress(np.concatenate(([0], 2 + rng.permutation(n), [1])), 2)) < 120
    for a in range(2, 3000):  # two symbols soon fall on different sides
        assert len(runs.compress(np.array([0, a, a + 1, 1]), 2)) < 60


@pytest.mark.parametrize("words,run", [(["a"] * 200000, (0, 200000, 1)), (["a", "b", "c"] * 50000, (0, 150000, 3)), ([str(i % 5003) for i in range(200000)], (0, 200000, 5003))])
def test_very_long(words, run):
    assert runs.runs_of([[w.encode() for w in words]])[0].tolist() == [list(run)]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, " \t\n", "x"), (None, "a\x0ba b", "x"), (3, "a " * 9, "x"), (3, "a " * 9, "x"), (4, "é é " + "x y " * 5 + "z", "x"), (5, "x y " * 5 + "x", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(frame).collect()]
    want = [(d, brute((t or "").split()), kept((t or "").split(), brute((t or "").split()))) for d, t, _ in rows if d != 4]
    want.append((4, [(1, 10, 2)], "é é x y z"))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.find_runs(frame.limit(0)).count() == 0
    named = spark.createDataFrame([("k", "b b b b b b")], "doc_id string, text string")
    assert [tuple(r.runs[0]) for r in runs.find_runs(named).collect()] == [(0, 6, 1)]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, t in docs:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        words = [w.decode() for w in words]
        found = brute(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in sorted(found, key=lambda r: (r[0], r[2]))), kept(words, found))]
        want[d] = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha)
    got = QUERIES["op11_runs"](spark, sf_dir).collect()
    assert len(got) == len(docs) and {r[0]: tuple(r)[1:] for r in got} == want
    assert sum(w[0] for w in want.values()) > 5
