"""Records of JSON documents that lie in many splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparcel.sources import nested


def values(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return [rng.randrange(99), "plain", 'say "}" and \\', "{[\"a\":}]", None, ""][kind]
    if kind == 6:
        return [values(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "days", "data", "b}c", 'q"']): values(rng, depth - 1) for _ in range(rng.randrange(4))}


def scan(spark, path, json_path, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        found = nested.scan_json(spark, str(path), json_path).select(F.to_json("record").alias("r")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return expected([json.loads(r.r) for r in found])


def expected(items):
    return sorted(json.dumps(x, sort_keys=True) for x in items)


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_array_below_names(spark, tmp_path, size):
    rng, items = random.Random(5), []
    for number in range(2):
        days = [values(rng, 3) for _ in range(60)]
        items += days
        around = {"before": values(rng, 3), "days": [{"not": "these"}], "data": {"x": [{"y": [1, {"z": 2}]}], "days": days, "more": {"days": [{"nor": "these"}]}}, "after": [{"data": {"days": [{"n": 1}]}}]}
        (tmp_path / f"{number}.json").write_text(json.dumps(around, indent=[None, 2][number], ensure_ascii=False), encoding="utf-8")
    assert scan(spark, tmp_path, "$.data.days[*]", size) == expected(items)


def test_root_array_and_further_steps(spark, tmp_path):
    rows = [{"k": i, "lines": [{"n": j, "s": "}{"} for j in range(i % 4)], "e": []} for i in range(150)]
    (tmp_path / "d.json").write_text(json.dumps(rows))
    assert scan(spark, tmp_path, "$[*].lines[*].n", 200) == expected([j["n"] for r in rows for j in r["lines"]])
    assert scan(spark, tmp_path, "$[*].k", 200) == expected([r["k"] for r in rows])
    (tmp_path / "d.json").write_text(" [ ] ")
    assert scan(spark, tmp_path, "$[*]", 200) == []
    (tmp_path / "d.json").write_text('{"a": [1, 2, "x"], "b": 1}')
    assert scan(spark, tmp_path, "$.a[*]", 200) == expected([1, 2, "x"])
    assert scan(spark, tmp_path, "$.b[*]", 200) == scan(spark, tmp_path, "$.none[*]", 200) == []


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"rows": [{"i": i, "t": "x" * 50} for i in range(3000)]}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = nested.scan_json(spark, str(tmp_path), "$.rows[*].i").select(F.variant_get("record", "$", "int").alias("i"))
        assert found.agg(F.count("*"), F.sum("i"), F.count_distinct("i")).first()[:] == (3000, 2999 * 1500, 3000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
