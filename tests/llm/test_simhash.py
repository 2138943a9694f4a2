import re

import numpy as np
import pytest
import xxhash

from sparcel.llm import simhash
from sparcel.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(doc, names.get(find(i), doc))
    return sorted(((d, f"{p:016x}", names.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


ROWS = [
    (5, None), (6, ""), (7, " \t\n"), (1, "Alpha beta"), (2, "ALPHA  beta"), (3, "alpha beta Ünï gamma delta"), (3, "alpha beta Ünï gamma delta"),
    (None, "one two three four five six"), (9, "one two three four five six"), (10, "x " * 70000), (11, "x " * 69999), (12, "ÀÉ àé"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "y") for d, t in rows], "doc_id long, text string, fp string")


def test_fingerprint():
    for _, text in ROWS:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_groups(spark):
    got = simhash.simhash_groups(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups(ROWS)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = simhash.simhash_groups(docs).collect()
    assert sorted(map(tuple, got), key=repr) == brute_groups([tuple(r) for r in docs.collect()])


def test_empty(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    kept = simhash.drop_near_duplicates(frame(spark, ROWS))
    assert kept.columns == ["doc_id", "text", "fp"]
    groups = brute_groups(ROWS)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, _, g in groups})


@pytest.mark.parametrize("piece", [20, 4096])
@pytest.mark.parametrize("radius", [0, 3, 4])
def test_links_against_brute_force(spark, piece, radius):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = set(map(int, centres)) | {0}
    for c in centres:
        for _ in range(30):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            values.add(int(c) ^ int(sum(1 << int(b) for b in flips)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius=radius, piece=piece)
    assert all((a ^ b).bit_count() <= 64 for a, b in links.collect())
    got = {r.node: r.root for r in connected_components(links).collect()}
    root = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius and root[signed[j]] < root[signed[i]]:
                    root[signed[i]] = root[signed[j]]
                    changed = True
    assert {v: got.get(v, v) for v in signed} == root


def test_nulls_in_other_columns_are_told_apart(spark):
    rows = [(1, "same words in here", None, "x"), (1, "same words in here", "x", None), (1, "same words in here", None, "x")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, a string, `b.c` string"))
    assert kept.count() == 1
