"""Sources found by name and by address."""

import pytest
from pyspark.sql import functions as F

from sparcel.sources import plugins
from sparcel.sources.synthetic import synthetic_records

KINDS = {"a": "animal", "i": "integer", "n": "number", "b": "boolean", "d": "date", "e": "email"}


def source(spark, reader, **options):
    plugins.register(spark)
    return reader.format("sparcel_synthetic").options(attributes=",".join(f"{k}={v}" for k, v in KINDS.items()), seed=5, **options).load()


def test_same_records_as_the_function(spark):
    want = synthetic_records(spark, 2500, KINDS, seed=5)
    got = source(spark, spark.read, count=2500, partition=400)
    assert got.rdd.getNumPartitions() == 7 and got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert source(spark, spark.read, count=0).count() == 0
    with pytest.raises(Exception, match="unknown attribute"):
        spark.read.format("sparcel_synthetic").options(attributes="x=nothing").load()


def test_ranges_are_pushed_down(spark):
    rows = source(spark, spark.read, count=10_000_000_000, partition=1000).filter("_offset >= 5000 AND _offset < 7500 AND a = 'cat'")
    assert rows.rdd.getNumPartitions() == 3
    want = synthetic_records(spark, 7500, KINDS, seed=5).filter("_offset >= 5000 AND a = 'cat'")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    assert source(spark, spark.read, count=100).filter("_offset = 7").count() == 1


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    for count in (700, 1500):
        query = source(spark, spark.readStream, count=count, batch=300).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()
        got = spark.read.parquet(path)
        assert got.agg(F.count("*"), F.count_distinct("_offset"), F.max("_offset")).first()[:] == (count, count, count - 1)
    want = synthetic_records(spark, 1500, KINDS, seed=5)
    assert got.select(want.columns).exceptAll(want).isEmpty()


def test_addresses(spark, tmp_path):
    sources = plugins.Sources()
    kinds = {u: sources.of(u).kind for u in ("s3a://b/x.CSV.gz", "f/y.tsv", "z.json", "z.ndjson", "d.parquet/", "table://a.b", "synthetic://9")}
    assert list(kinds.values()) == ["csv", "csv", "json", "jsonl", "parquet", "table", "synthetic"]
    with pytest.raises(ValueError, match="no source"):
        sources.of("ftp://nowhere")
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert sources.open(spark, str(tmp_path / "x.csv"), header_row=None).count() == 2
    assert sources.open(spark, "synthetic://30?who=first_name&n=integer", seed="2").columns == ["_offset", "who", "n"]
    sources.add(plugins.Description("mine", "Mine", r"\.csv$", lambda spark, uri: spark.range(4)))
    assert sources.open(spark, str(tmp_path / "x.csv")).count() == 4


def test_a_long_stream_takes_a_bounded_number_of_batches(spark, tmp_path):
    """A fixed batch made the micro-batches, and the reads of what is joined to them, grow with the records."""
    path, sizes = str(tmp_path / "out"), []
    stream = source(spark, spark.readStream, count=1500, batch=10, batches=4, partition=200)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    query.stop()
    assert sizes == [375] * 4
    got = spark.read.parquet(path)
    assert got.agg(F.count("*"), F.count_distinct("_offset"), F.max("_offset")).first()[:] == (1500, 1500, 1499)


def test_few_records_keep_their_batch(spark):
    for options, size in (({"batch": "400", "batches": "4"}, 400), ({"batch": "400"}, 400), ({"batch": "10", "batches": "7"}, 143)):
        assert plugins.SyntheticSource({"count": "1000", **options}).streamReader(None).latestOffset() == {"next": size}
