import math

import numpy as np
import pytest

from sparcel.llm import quantised
from sparcel.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(rows, cosine=0.95):
    def sound(v):
        return v is not None and any(x for x in v if x is not None) and all(x is not None and math.isfinite(x) for x in v)

    units = [np.array(v) / max(map(abs, v)) if sound(v) else None for _, v in rows]
    units = [u if u is None else u / np.linalg.norm(u) for u in units]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            names[find(i)] = min(vec, names.get(find(i), vec))
    return sorted(((v, links[i], names.get(find(i)), v == names.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, node string")


def planted(n, dim, seed):
    """Random vectors, and copies of some turned by angles on both sides of the bound."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    out = [b for b in base]
    for k in range(n // 2):
        u = base[k % 40] / np.linalg.norm(base[k % 40])
        w = rng.normal(size=dim)
        w -= (w @ u) * u
        c = rng.uniform(0.94, 0.97)
        out.append((c * u + math.sqrt(1 - c * c) * w / np.linalg.norm(w)) * rng.uniform(0.1, 9))
    return [(k, [float(x) for x in v]) for k, v in enumerate(out)]


ODD = [
    (900, None), (901, []), (902, [0.0] * 12), (903, [1.0, None] + [0.0] * 10), (904, [NAN] + [1.0] * 11), (905, [INF] + [1.0] * 11),
    (906, [1.0, 2.0]), (907, [2.0, 4.0]), (907, [2.0, 4.0]), (None, [1.0, 2.0]), (None, [-1.0, 2.0]), (908, [-0.0, 3.0]), (909, [0.0, 1.0]),
    (910, [1e300] * 12), (911, [1e-300] * 12), (5, [1.0] * 12),
]


@pytest.mark.parametrize("sizes", [{}, {"lists": 7, "piece": 16, "askers": 20}, {"lists": 1, "piece": 50}])
def test_exact_bound_loses_nothing(spark, sizes):
    rows = planted(160, 12, 3) + ODD
    got = quantised.near_vectors(frame(spark, rows), spread=math.sqrt(16), **sizes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_recall_with_default_probes(spark):
    rows = planted(1500, 64, 5)
    got = {r.vec_id: r.n_links for r in quantised.near_vectors(frame(spark, rows, "float"), lists=64).collect()}
    want = {r[0]: r[1] for r in brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows])}
    assert all(got[k] <= n for k, n in want.items())  # none below the bound
    assert sum(got.values()) >= 0.97 * sum(want.values()) > 900


def test_code_bound_holds():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = quantised.Index(quantised._means(x, 5), np.stack([quantised._means(x[:, 2 * s : 2 * s + 2], 16) for s in range(8)]))
    home, codes, errors, _ = quantised.encode(index, x, 3.0, 0.3)
    for k in range(0, 400, 37):
        same = home == home[k]
        far = sum(quantised.lookups(index, home[k], x[:50])[s][:, codes[same][:, s]] for s in range(8))
        real = np.linalg.norm(x[:50, None] - x[None, same], axis=2)
        assert (np.abs(np.sqrt(far) - real) <= errors[same] + 1e-3).all()


def test_empty(spark):
    assert quantised.near_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in quantised.near_vectors(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, QUERIES["op12_vectors"](spark, sf_dir).collect()), key=repr) == brute(rows)
