import math

import numpy as np
import pytest

import __spark_entry__ as entry
from sparcel.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, queries, k=5):
    def whole(rows):
        return [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    out = set()
    for q, v in whole(queries):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole(rows) if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


ROWS = (
    [(i, [0.5, -0.25, 0.1 * (i % 3)]) for i in range(12)] + [(3, [0.5, -0.25, 0.0])] * 2 + [(50, [0.0, 0.0, 0.0]), (51, []), (52, []), (53, None), (54, [1.0, None, 2.0])]
    + [(55, [1.0, float("nan"), 2.0]), (56, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (57, [9.0]), (58, [-1e6, 1e6, 3.0])]
)


def test_edges(spark):
    docs = spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1) for i, v in ROWS], SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = T.top_k(docs, docs).collect()
    assert {tuple(r) for r in got} == brute(rows, rows)
    assert len(got) == len({tuple(r) for r in got})
    assert T.top_k(docs.limit(0), docs).count() == 0
    assert T.top_k(docs, docs.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [3, 1000])
def test_blocks_against_brute_force(spread):
    rng = np.random.default_rng(2)
    rows = rng.integers(-spread, spread + 1, (3000, 12))
    rows[500:900] = rows[3]
    ids = rng.permutation(3000)
    lists = T.Lists(ids, rows)
    for own, query in [(int(ids[3]), rows[3]), (int(ids[7]), rows[7]), (-1, np.eye(12, dtype=int)[2] * 5), (-1, np.zeros(12, int)), (-1, np.full(12, 10**9)), (-1, np.full(12, 10**13))]:
        row, score = lists.top(query, own, 5)
        want = sorted((-int(s), int(i)) for s, i in zip(rows @ query, ids) if i != own)[:5]
        assert [(-int(s), int(lists.ids[r])) for r, s in zip(row, score)] == want


def test_stops_before_the_end():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 1000, (8000, 2))
    lists = T.Lists(np.arange(8000), rows)
    seen, whole = [], lists.exact(np.array([1, 1]))

    class Counting(np.ndarray):
        def __getitem__(self, key):
            seen.append(key)
            return np.asarray(self)[key]

    lists.as_type[np.float32] = whole.view(Counting)
    row, score = lists.top(np.array([1, 1]), -1, 5)
    assert sorted(score) == sorted(np.sort(rows.sum(axis=1))[-5:])
    assert 0 < sum(len(k) for k in seen if isinstance(k, np.ndarray)) < 4000


def test_scores_beyond_exact_raise():
    with pytest.raises(OverflowError):
        T.Lists(np.arange(2), np.full((2, 3), 10**10)).top(np.full(3, 10**10), -1, 1)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {tuple(r) for r in entry.queries()["op8_topk"](spark, sf_dir).collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 50 == 0])
