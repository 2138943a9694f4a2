"""Deliveries and running profiles that stop half-way."""

import time

import pytest
from pyspark.sql import functions as F

from sparcel.operators import profile as P
from sparcel.sinks import state as D
from sparcel.streaming import ingest as S
from sparcel.streaming.inspection import inspect_files

SCHEMA, STATE = "id long, v string", "stream string, stream_offset bigint, update_hash string, updated_at timestamp"


def state_of(rows):
    return D.state_of_delivery(rows.withColumn("stream", F.lit("s")), ("stream",), "id", F.current_timestamp(), complete=False)


def run(spark, store, upto, how=state_of):
    last = store.state().agg(F.max("stream_offset")).first()[0]
    rows = spark.range(0 if last is None else last + 1, upto).select("id", F.concat(F.lit("v"), "id").alias("v"))
    return store.deliver(rows, how)


def ids(store):
    return sorted(r.id for r in store.read().collect())


def test_a_run_that_dies_leaves_nothing_behind(spark, tmp_path):
    store = D.Delivery(spark, str(tmp_path), SCHEMA, STATE, ("stream",))
    assert ids(store) == [] and store.folders() == []
    run(spark, store, 10)

    def dies(rows):
        raise InterruptedError

    with pytest.raises(InterruptedError):
        run(spark, store, 25, dies)
    assert ids(store) == list(range(10))
    run(spark, D.Delivery(spark, str(tmp_path), SCHEMA, STATE, ("stream",)), 25)
    run(spark, store, 25)
    assert ids(store) == list(range(25))
    assert store.state().first().stream_offset == 24
    store.compact()
    assert ids(store) == list(range(25)) and len(store.folders()) == 1
    assert store.sweep() >= 1 and ids(store) == list(range(25))


def test_two_deliveries_at_once(spark, tmp_path):
    store = D.Delivery(spark, str(tmp_path), SCHEMA, STATE, ("stream",))
    run(spark, store, 5)

    def overtaken(rows):
        run(spark, D.Delivery(spark, str(tmp_path), SCHEMA, STATE, ("stream",)), 8)
        return state_of(rows)

    with pytest.raises(D.ConcurrentCommit):
        run(spark, store, 9, overtaken)
    assert ids(store) == list(range(8))
    run(spark, store, 9)
    assert ids(store) == list(range(9))


def test_a_failed_commit_is_run_again(spark, tmp_path, monkeypatch):
    store = D.Delivery(spark, str(tmp_path), SCHEMA, STATE, ("stream",))
    run(spark, store, 4)
    with monkeypatch.context() as m:
        m.setattr(D.Delivery, "publish", lambda *_: (_ for _ in ()).throw(InterruptedError()))
        with pytest.raises(InterruptedError):
            run(spark, store, 9)
    run(spark, store, 9)
    assert ids(store) == list(range(9))
    store.deliver(spark.range(2).select("id", F.lit("new").alias("v")), state_of, replace=True)
    assert ids(store) == [0, 1]


def test_inspection_is_cancelled_when_its_budget_is_over(spark, tmp_path):
    spark.range(8).repartitionByRange(8, "id").write.parquet(str(tmp_path / "in"))
    files = sorted(str(f) for f in (tmp_path / "in").glob("*.parquet"))

    def slow(some):
        @F.udf("long")
        def wait(i):
            time.sleep(60 if i >= 3 else 0)
            return i

        return spark.read.schema("id long").parquet(*some).select(wait("id").alias("id"))

    began = time.monotonic()
    seen = inspect_files(spark, files, slow, str(tmp_path / "out"), 6)
    assert time.monotonic() - began < 40 and not seen.finished and 1 <= len(seen.done) <= 3
    assert seen.counts().first()[:] == (len(seen.done), len(seen.done), "GREATER_THAN")
    hashes = spark.createDataFrame([(f, "h") for f in files], "file string, update_hash string")
    assert {r.update_hash for r in seen.state(hashes).collect()} == {None}
    whole = inspect_files(spark, files, lambda some: spark.read.schema("id long").parquet(*some), str(tmp_path / "again"), 600)
    assert whole.finished and whole.counts().first()[1:] == (8, "EXACT") and whole.state(hashes).filter("update_hash = 'h'").count() == 8
    assert whole.profile().first()["number_max"] == 7
    with pytest.raises(Exception, match="boom"):
        inspect_files(spark, files, lambda some: spark.read.schema("id long").parquet(*some).select(F.raise_error(F.lit("boom")).cast("long").alias("x")), str(tmp_path / "bad"), 600)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_profile_over_restarts(spark, tmp_path, monkeypatch, by):
    monkeypatch.setattr(S, "COMPACT", 2)
    source, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    whole = spark.range(60).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") < 30, F.col("id").cast("string")).otherwise(F.concat(F.lit("1."), "id")).alias("t"))
    for part in range(5):
        whole.filter(F.col("id").between(part * 12, part * 12 + 11)).filter("id < 24 OR g = 1").coalesce(1).write.mode("append").parquet(source)
        stream = S.read_files(spark, source, whole.schema, files_per_batch=1)
        S.stream_profile(stream, target, checkpoint, raw=["t"], by=by).awaitTermination()
    got, want = S.newest_profile(spark, target, by), P.profile(spark.read.parquet(source), raw=["t"], by=by)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("batch=")]) <= 2
