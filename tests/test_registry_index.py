"""Stems, the index in segments, and prefix keys."""

import pytest
from pyspark.sql import functions as F

from sparcel.registry import prefixes
from sparcel.registry import search as Q
from sparcel.registry import segments as G
from sparcel.registry.stems import stems, stems_of

# Examples of the published rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "gyroscopic": "gyroscop", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "rolls": "roll",
    "package": "packag", "packages": "packag", "packaging": "packag",
}


def test_stems(spark):
    assert {w: s for w, s in zip(STEMS, stems_of(spark, list(STEMS)))} == {w: [s] for w, s in STEMS.items()}
    assert stems_of(spark, ["The cats' and THE dogs, of 1999s!", "is of the", "", "Café über straßes"]) == [["cat", "dog", "1999s"], [], [], ["café", "über", "straßes"]]
    assert stems_of(spark, []) == []
    df = spark.createDataFrame([(None,), ("x" * 100000,)], "t string")
    assert [r[0] and len(r[0][0]) for r in df.select(stems(F.col("t"))).collect()] == [None, 100000]


def index_of(spark, path):
    return G.SegmentIndex(spark, str(path), "id", ["a", "b"])


def rows(spark, texts):
    return spark.createDataFrame([(k, *t) for k, t in texts.items()], "id long, a string, b string")


def held(index):
    return sorted((r.token, r.field, r.id) for r in index.entries().collect())


def expected(spark, texts):
    flat = [(k, f, t) for k, ts in texts.items() for f, t in zip("ab", ts) if t]
    return sorted({(s, f, k) for (k, f, _), words in zip(flat, stems_of(spark, [t for _, _, t in flat])) for s in words})


def test_segments_follow_every_change(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "FANOUT", 3)
    monkeypatch.setattr(G, "LEAST", 40)
    index, texts = index_of(spark, tmp_path), {k: (f"packages of {k} red", f"boxes {k % 3}") for k in range(50)}
    assert held(index) == []
    first = index.refresh(rows(spark, texts))
    changes = [{3: ("blue packaging", None)}, {3: ("green", "x"), 60: ("new", "rows")}, {4: (None, None)}, {60: ("newer", None), 5: ("red", "boxes")}, {1: ("last", "")}]
    for change in changes:
        texts.update(change)
        assert index.refresh(rows(spark, change)) <= 6 < first
        assert held(index) == expected(spark, texts)
    assert len(index.segments()) < 1 + len(changes)
    assert index.sweep() >= 3 and held(index_of(spark, tmp_path)) == expected(spark, texts)
    found = index.lookup(["packag", "red"])
    assert sorted((r.token, r.id) for r in found.collect()) == sorted((t, k) for t, f, k in expected(spark, texts) if t in ("packag", "red"))
    assert "PushedFilters: [In(token" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query,want", [
    ("packages", {1, 2}), ("package -boxes", {1, 2}), ('"red package"', {2}), ("the of", {5}), ("packaging or cats", {1, 2, 3}), ("red boxes", set()), ("-package", {2, 3, 4, 5}), ('cat -"fat cats"', {3}), ("plain", {4, 5}),
])
def test_search_by_stems_and_fields(spark, tmp_path, query, want):
    texts = {1: ("Package, red", None), 2: ("a red packaging", "box"), 3: ("cats", "fat cat"), 4: ("plain", ""), 5: ("the of plain", "of")}
    df, index = rows(spark, texts), index_of(spark, tmp_path)
    index.refresh(df)
    # one field has to match by itself: "red" and "boxes" of row 2 lie in two, and its "box" is no part of the other
    got = {r.id for r in Q.search_fields(df, index, query, F.col("a").contains(query)).collect()}
    assert got == want


def test_prefix_keys(spark, tmp_path):
    users = spark.createDataFrame([(1, "Ada", "A@x", True), (2, "bob", "ada@x", False), (3, None, "adam@x", None), (4, "", "b", True)], "user_id long, name string, mail string, shown boolean")
    keys = prefixes.prefix_keys(users, "user_id", {"name": "name", "mail": "mail"}, {"inner": "name"}, {"mail": F.col("shown")})
    prefixes.write_prefixes(keys, str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    ids = lambda *a, **k: {r.id for r in prefixes.complete(keys, *a, **k).collect()}
    assert ids("AD") == {1} and ids("ad", only_public=False) == {1, 2, 3} and ids("b") == {2, 4} and ids("zz") == set()
    assert ids("da", prefixes.INSIDE) == {1} and ids("o", prefixes.INSIDE) == {2} and ids("", prefixes.INSIDE) == {1, 2}
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    assert "StringStartsWith(prefix_key,ad)" in prefixes.complete(keys, "ad")._jdf.queryExecution().executedPlan().toString()


def test_texts_are_taken_apart_once(spark, tmp_path):
    """Sorting by range looks at its rows twice; the stems of a text must not be worked out again for that."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        seen.add(1)
        return f"packages of {n}"

    df = spark.range(0, 200, 1, 4).select("id", text("id").alias("a"), F.lit(None).cast("string").alias("b"))
    index = index_of(spark, tmp_path)
    assert index.refresh(df) == 400 and seen.value == 200
    assert index.lookup(["packag"]).count() == 200


def test_words_of_texts_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "Red, red fox"), (2, None), (3, ""), (None, "fox")], "id long, t string")
    index = Q.text_index(df, "id", "t")
    assert sorted(map(tuple, index.collect()), key=repr) == [("fox", 1), ("fox", None), ("red", 1)]
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    twice = Q.text_index(df.union(df), "id", "t")
    assert [r.id for r in Q.search_index(twice, "id", "red fox").collect()] == [1]


def test_packages_of_one_row_group_are_taken_apart_by_all_cores(spark, tmp_path, monkeypatch):
    from sparcel.checks import registry

    columns = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([(i, f"red plate {i}", "B", "T", i % 7, 1.0) for i in range(100)], columns).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    parts, refresh = [], G.SegmentIndex.refresh
    monkeypatch.setattr(G.SegmentIndex, "refresh", lambda self, df, **more: parts.append(df.rdd.getNumPartitions()) or refresh(self, df, **more))
    assert registry._segments(spark, str(tmp_path), "packages").lookup(["plate"]).count() == 100
    assert parts == [spark.sparkContext.defaultParallelism]
