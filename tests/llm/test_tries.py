import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sparcel.llm import tries
from sparcel.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, node string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        below = [totals[k] for k in children[node]]
        totals[node] = (sum(b[0] for b in below) or (0 if below else 1), saved + sum(b[1] for b in below))
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *totals[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def trie(spark, rows, block):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, tries.prefix_trie(*tries.grafted(tries.numbered_turns(frame)), block=block).collect()))


def chats(seed, convs, words=2, most=9):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(0, most))):
            rows.append((c, t, ["user", "assistant"][t % 2], "é😀"[: int(rng.integers(0, words + 1))]))
    return rows


ODD = [
    (None, 0, "user", "lost"), (7, None, None, None), (7, 3, "user", "b"), (7, 3, "user", "a"), (7, 3, "user", "a"), (7, -1, "", ""), (300, 0, "user", "x"),
    (301, 0, "user", "x"), (302, 1, "a", "bc"), (303, 1, "ab", "c"), (400, 0, "user", "y"), (512, 0, "user", "alone"), (-5, 0, "user", "x"),
] + [(601, t, "user", str(t)) for t in range(40)]


@pytest.mark.parametrize("block,rows", [(2, ODD), (20, chats(1, 130) + ODD), (1 << 13, chats(1, 130) + ODD)])
def test_against_brute_force(spark, block, rows):
    assert trie(spark, rows, block) == brute(rows)


def test_long_conversation_is_numbered_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 7)
    rows = [(c, t, "user", str(t % 3)) for c in (100, 101, 250) for t in range(60)]
    assert trie(spark, rows, 20) == brute(rows)


def test_empty(spark):
    assert trie(spark, [(None, 1, "user", "x")], 8) == []


def test_decompose_against_plain_sums():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        for shape in ("random", "chain", "star"):
            parent = np.array([-1] + [{"random": int(rng.integers(-1, k)), "chain": k - 1, "star": 0}[shape] for k in range(1, n)])
            values = rng.integers(0, 9, (n, 2))
            weight, sums = rng.integers(1, 4, n), values.copy()
            for k in range(n - 1, 0, -1):
                if parent[k] >= 0:
                    weight[parent[k]] += weight[k]
                    sums[parent[k]] += sums[k]
            assert (tries.decompose(parent, weight, values) == sums).all()


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_trie"](spark, sf_dir).collect())) == brute(rows)
