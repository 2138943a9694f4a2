import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sparcel.operators import sampling as SA
from sparcel.operators import labels as L
from sparcel.operators import profile as P
from sparcel.operators import projection as R
from sparcel.operators import resolve as C
from sparcel.operators import shapes as S
from sparcel.plans import diff as X
from sparcel.plans import upgrade as U
from sparcel.registry import notifications as N
from sparcel.registry import search as Q
from sparcel.sinks import batches as B
from sparcel.sinks import files as W
from sparcel.sinks import tables as DB
from sparcel.streaming import ingest as I


def labels_of(df):
    return {(r["property"], r["label"]) for r in L.scan_content_labels(df).filter("applied").collect()}


def test_content_labels(spark):
    row = ("123-45-6789", "4111111111111111", "10.0.0.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "555-123-4567", "a@b.co",
           "call 555-123-4567 now", "no label", 1.5, 30, "m")
    names = "ssn string, cardNumber string, ipv4 string, ipv6 string, phone string, mail string, sentence string, plain string, geo_latitude double, age int, sex string"
    assert labels_of(spark.createDataFrame([row] * 3, names)) == {
        ("ssn", "social_security_number"), ("cardNumber", "credit_card_number"), ("ipv4", "ip_v4_address"), ("ipv6", "ip_v6_address"),
        ("phone", "phone_number"), ("sentence", "phone_number"), ("mail", "email_address"), ("geo_latitude", "geo_latitude"), ("age", "age"), ("sex", "gender")}


@pytest.mark.parametrize("text, hit", [("666-45-6789", False), ("000-12-3456", False), ("900-12-3456", False), ("123-00-6789", False),
                                       ("123-45-0000", False), ("x123-45-6789", False), ("é123-45-6789", True), ("123456789", True)])
def test_ssn(spark, text, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(L.detect(F.col("t"), "social_security_number")).first()[0] is hit


def test_label_threshold(spark):
    df = spark.createDataFrame([("a@b.co",), ("a@b.co",), ("x",)], "t string")
    row = L.scan_content_labels(df).first()
    assert (row["occurrence_count"], row["tested_count"], row["applied"]) == (2, 3, True)
    assert not L.scan_content_labels(df.limit(2).union(df)).filter("applied and occurrence_count = 3").collect()


def test_person_names(spark):
    names = spark.createDataFrame([("Ada",), ("Lovelace",)], "name string")
    texts = ["Ada Lovelace", "Ada Smith", "A rather long sentence of words that mentions Ada somewhere inside", "nobody is in this long sentence about nothing at all, really"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    row = L.detect_person_names(df, ["t"], names).first()
    assert (row["occurrence_count"], row["tested_count"]) == (2, 4)
    same = spark.createDataFrame([(1, "ada lovelace"), (1, "lovelace ada"), (1, "ada lovelace")], "id int, t string")
    row = L.detect_person_names(same, ["t"], names).first()
    assert (row["occurrence_count"], row["tested_count"], row["applied"]) == (3, 3, True)


def test_sample_follows_its_schedule(spark, monkeypatch):
    monkeypatch.setattr(SA, "BLOCK", 16)
    monkeypatch.setattr(SA, "CHUNK", 5)
    values = [(i, None if i % 7 == 0 else f"v{i}", i % 3) for i in range(3000)] + [(None, "x", 1), (2999, "a", 1)]
    df = spark.createDataFrame(values, "n long, t string, k int").repartition(5)
    got = SA.sampled_values(df, "n", seed=3).collect()
    for name, kind, rows in (("t", "string", sorted((i, v) for i, v, _ in values if i is not None and v)), ("k", "integer", sorted((i, str(k)) for i, _, k in values if i is not None))):
        rank, test, want = 0, 0, []
        while rank < len(rows):
            want.append((rank, test, *rows[rank]))
            test += 1
            wait = 1
            if test > 100:
                u = int(hashlib.md5(f"3-{name}-{kind}-{test}".encode()).hexdigest()[:8], 16) / 2**32
                wait = 1 + math.floor(math.log(1 - u) / math.log(1 - 1 / (test - 99)))
            rank += wait
        assert sorted((r["rank"], r.test, r.position, r.value) for r in got if r.property == name) == want
        assert 140 < len(want) < 240  # about 101 + sqrt(2 * 2900)



def test_digits_of_large_numbers(spark):
    for value, digits in ((2.0**63, 19), (1e19, 20), (5e18, 19), (1e37, 38), (1e300, 301), (9999999999.9, 11), (-1.5e20, 21)):
        row = P.profile(spark.createDataFrame([(value,)], "v double")).first()
        assert row["number_max_precision"] == digits, value


def test_option_sketches_merge(spark):
    rows = [(i % 40, "ab" * (i % 30), f"t{i}", i % 2 == 0, "x" if i % 3 else "2020-01-02") for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string, t string, b boolean, raw string")
    parts = [P.option_profile(df.filter(f"k % 3 {op} 0"), raw=["raw"]) for op in ("=", "<>")]
    # an empty text is not counted, which the exact test that follows allows for
    merged = {(r["property"], r["type"]): r["about"] for r in P.merge_profiles(*parts).select("property", "type", F.theta_sketch_estimate("distinct_sketch").alias("about")).collect()}
    assert {k: v for k, v in merged.items() if k[0] != "t"} == {("k", "integer"): 40, ("s", "string"): 29, ("b", "boolean"): 2, ("raw", "string"): 1, ("raw", "date"): 1}
    assert merged["t", "string"] > 1000
    few = {(r["property"], r["type"]) for r in P.with_few_options(P.merge_profiles(*parts)).collect()}
    assert few == {("k", "integer"), ("b", "boolean"), ("raw", "string"), ("raw", "date")}
    options = P.value_options(df, raw=["raw"])
    assert options._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert {r["property"]: r["n"] for r in options.groupBy("property").agg(F.sum("n").alias("n")).collect()} == {"k": 3000, "b": 3000, "raw": 3000}


def test_notifications_of_unknown_actors(spark):
    log = spark.createDataFrame(
        [(1, "2024-01-01 00:00:01", None, "E", None, 5, ["slug"]), (2, "2024-01-01 00:00:02", 7, "E", None, 5, ["readme"]), (3, "2024-01-01 00:00:03", None, "E", None, 5, ["slug"]), (4, "2024-01-01 00:00:04", 7, "E", None, 6, None)],
        "id long, created_at string, user_id long, event_type string, change_type string, target_catalog_id long, properties_edited array<string>",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    follows = spark.createDataFrame([(7, 5, ["E"], "DAILY"), (8, 5, ["E"], "DAILY"), (8, 6, ["E"], "DAILY"), (7, 6, ["E"], "DAILY")], "user_id long, target_catalog_id long, event_types array<string>, frequency string")
    rows = N.notify_by_catalog(log, follows, dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1), "DAILY").collect()
    got = {(r.user_id, r.target_id): (r.n_actions, r.n_actors, r.first_at.second, r.last_at.second, r.first_actor_id, r.properties_edited) for r in rows}
    assert got == {(7, 5): (2, 1, 1, 3, None, ["slug"]), (8, 5): (3, 2, 1, 3, None, ["readme", "slug"]), (8, 6): (1, 1, 4, 4, 7, [])}


def test_conflicts(spark):
    conflicts = spark.createDataFrame([("p", ["date", "integer"]), ("q", ["boolean", "date", "string"])], "property string, types array<string>")
    got = {r["property"]: r["options"] for r in C.conflict_options(conflicts).collect()}
    assert got == {"p": ["CAST_TO_INTEGER", "CAST_TO_DATE", "CAST_TO_STRING", "ALL"], "q": ["CAST_TO_STRING", "ALL"]}
    bad = spark.createDataFrame([("p", ["array", "date"])], "property string, types array<string>")
    with pytest.raises(Exception, match="no resolution"):
        C.conflict_options(bad).collect()
    assert C.apply_resolution({"p": ["null", "string", "date"]}, {"p": C.SKIP}) == {"p": ["date"]}
    with pytest.raises(ValueError):
        C.apply_resolution({"p": ["string", "date", "integer"]}, {"p": C.NULL})


def test_merge_is_profile_of_whole(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    whole = P.profile(orders)
    parts = [P.profile(orders.filter(f"o_orderpriority {op} '3'")) for op in ("<", ">=")]
    merged = P.merge_profiles(*parts)
    assert whole.exceptAll(merged.select(*whole.columns)).count() == 0 and merged.count() == whole.count()


def test_diff_of_same_is_empty(spark):
    rows = [("s", ["a"], ["string"], False, "u", "d"), ("s", ["o"], ["object"], False, None, None), ("s", ["o", "x"], ["integer"], True, None, None)]
    schema = "schema string, path array<string>, types array<string>, hidden boolean, unit string, description string"
    prior = spark.createDataFrame(rows, schema)
    assert X.diff_properties(prior, prior).count() == 0
    gone = prior.filter("path[0] <> 'o'")
    assert [tuple(r) for r in X.diff_properties(prior, gone).collect()] == [("REMOVE_PROPERTY", "#/s/properties/o")]
    inner = prior.filter("size(path) = 1")
    assert [tuple(r) for r in X.diff_properties(prior, inner).collect()] == [("REMOVE_HIDDEN_PROPERTY", "#/s/properties/o/properties/x")]
    with pytest.raises(Exception, match="not mapped"):
        X.diff_compatibility(spark.createDataFrame([("X",)], "difference string")).collect()


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"a":1,"b":[2]}', '{ "b": [2], "a": 1 }')], "x string, y string")
    assert df.select(X.canonical_json(F.col("x")) == X.canonical_json(F.col("y"))).first()[0]


def test_upgrade_first_format():
    old = {"displayName": "D", "packageSlug": "d", "schemas": [{
        "title": "t", "recordCount": 5, "recordCountApproximate": True, "source": {"uri": "file:///x", "type": "file", "lastUpdateHash": "h"},
        "properties": {"p": {"valueTypes": {"number": {"numberMaxValue": "1.5", "dateMaxValue": None}}}}}]}
    new = U.upgrade(old)
    assert U.format_of(new) == U.CURRENT and new["canonical"] is True
    assert new["sources"][0]["streamSets"][0]["streamStats"]["inspectedCount"] == 5
    assert new["sources"][0]["streamSets"][0]["updateMethods"] == []
    assert new["schemas"][0]["properties"]["p"]["types"] == {"number": {"numberMaxValue": 1.5}}
    assert new["schemas"][0]["recordCountPrecision"] == "APPROXIMATE" and new["licenseMarkdown"]


def test_bad_offset_and_unknown_schema(spark):
    df = spark.createDataFrame([(1, 5)], "_offset long, _last long")
    with pytest.raises(Exception, match="must be greater"):
        B.check_offsets(df).collect()
    with pytest.raises(Exception, match="unknown schema"):
        R.check_known_schemas(spark.createDataFrame([("z",)], "_schema_slug string"), ["a"]).collect()
    with pytest.raises(ValueError, match="unknown schema z"):
        R.route_by_schema(spark.createDataFrame([("z",)], "_schema_slug string"), {"a": lambda d: None})
    twice = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2)], "stream string, _offset long")
    assert [r["_offset"] for r in B.repeated_offsets(twice, ("stream",)).collect()] == [1]


def test_shapes(spark):
    with pytest.raises(ValueError):
        S.document_schema({"p": ["object"]})
    assert S.relational_ddl({"a.b": ["integer"], "c": ["null", "string", "date"]}) == '"a_b" bigint, "c-string" text, "c-date" date'
    assert S.columnar_type(["string", "integer"]) == "string" and S.columnar_type(["null"]) == "string"
    df = spark.createDataFrame([("x",)], "m string")
    with pytest.raises(Exception, match="not declared"):
        S.document_shape(df, {"m": ["integer", "date"]}).collect()
    nested = spark.createDataFrame([((1, [2.5]),)], "o struct<a:int, b:array<double>>")
    assert S.stream_table_schema(nested.schema, {"o": 1}) == [{"name": "o", "type": "ROW(a BIGINT, b ARRAY<DECIMAL(31,1)>)"}]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2020, 2, 1, 11, 53))], "a int, t timestamp").coalesce(1)
    W.csv_sink(df, str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ['"a","t"', '"1","2020-02-01T11:53:00.000Z"']
    assert W.write_mode("APPEND_ONLY_LOG") == "append" and W.write_mode("CONTINUOUS", replace=True) == "overwrite"
    assert DB.swap_statements("t")[1] == 'ALTER TABLE "t_new" RENAME TO "t"'
    assert DB.jdbc_write_options("u", "t", "me", {"a": ["integer"]})["batchsize"] == "100"


def test_web_query():
    query = Q.web_query('big "red car" or bike -blue')
    assert query.any_of == (("big", "red car"), ("bike",)) and query.none_of == ("blue",)


def test_streaming_helpers():
    assert I.back_off(1) == 10 and I.back_off(60) == 30
    assert I.update_hash_after(False, "h") is None and I.count_precision(False) == "GREATER_THAN"
    waits = I.run_until_stopped(lambda: type("Q", (), {"awaitTermination": lambda self: None})(), 2, sleep=lambda s: None)
    assert len(waits) == 2


def test_actor_text(spark):
    df = spark.createDataFrame([("X", 1), ("X", 2), ("X", 3)], "n string, k int")
    assert [r[0] for r in df.select(N.actor_text(F.col("n"), F.col("k"))).collect()] == ["X", "X", "X and 2 other users"]
