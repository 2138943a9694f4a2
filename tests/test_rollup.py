"""Sums of the log by minute, hour and day against the log itself."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparcel.registry import rollup as R

BEGIN = dt.datetime(2024, 3, 1, 22, 30)
SCHEMA = "id long, created_at timestamp, user_id long, event_type string, change_type string, target_catalog_id long, target_collection_id long, target_package_id long, properties_edited array<string>"


def log_rows(count, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        at = BEGIN + dt.timedelta(seconds=rng.choice([rng.randrange(200_000), 60 * rng.randrange(3000), 3600 * rng.randrange(50)]), microseconds=rng.choice([0, 0, 1, 999_999]))
        rows.append((i, at, rng.choice([None, 1, 2, 3]), rng.choice("EF"), rng.choice([None, "A", "B"]), rng.choice([None, 5, 6]), None, rng.choice([None, 7]), rng.choice([None, ["slug"], ["slug", "readme"]])))
    return rows


def expected(rows, start, end):
    out = {}
    for i, at, user, event, change, catalog, collection, package, edited in rows:
        if start < at <= end:
            for kind, target in (("catalog", catalog), ("collection", collection), ("package", package), ("user", user)):
                if target is not None:
                    n, first, last, props = out.get((kind, target, event, change, user), (0, (at, i), at, frozenset()))
                    out[kind, target, event, change, user] = (n + 1, min(first, (at, i)), max(last, at), props | set(edited or ()))
    return out


WINDOWS = {
    "INSTANT": (BEGIN + dt.timedelta(hours=3), BEGIN + dt.timedelta(hours=3, seconds=60)), "HOURLY": (BEGIN + dt.timedelta(seconds=7), BEGIN + dt.timedelta(hours=2, microseconds=3)),
    "DAILY": (BEGIN + dt.timedelta(minutes=90), BEGIN + dt.timedelta(hours=26, minutes=90)), "WEEKLY": (BEGIN - dt.timedelta(days=7), BEGIN + dt.timedelta(days=30)),
    "MONTHLY": (BEGIN + dt.timedelta(seconds=10), BEGIN + dt.timedelta(seconds=11)),
}


def counted(spark, rollup, log):
    windows = spark.createDataFrame([(k, *w) for k, w in WINDOWS.items()], "frequency string, window_start timestamp, window_end timestamp")
    out = {k: {} for k in WINDOWS}
    for r in rollup.counted(log, windows).collect():
        out[r.frequency][r.kind, r.target, r.event, r.change, r.actor] = (r.n, (r["first"].created_at, r["first"].id), r.last_at, frozenset(r.edited))
    return out


@pytest.mark.parametrize("untils", [[], [26], [5, 5.01, 30, 61]])
def test_windows_of_any_edges(spark, tmp_path, untils):
    rows = log_rows(900)
    log, rollup = spark.createDataFrame(rows, SCHEMA), R.LogRollup(spark, str(tmp_path))
    for hours in untils:
        rollup.update(log, BEGIN + dt.timedelta(hours=hours, seconds=17))
    want = {k: expected(rows, *w) for k, w in WINDOWS.items()}
    assert sum(map(len, want.values())) > 60
    assert counted(spark, rollup, log) == want
    if len(untils) > 1:
        assert rollup.update(log, BEGIN) == 0
        rollup.compact()
        assert counted(spark, rollup, log) == want


def test_an_update_that_dies_is_run_again(spark, tmp_path, monkeypatch):
    rows = log_rows(300, 2)
    log, rollup = spark.createDataFrame(rows, SCHEMA), R.LogRollup(spark, str(tmp_path))
    rollup.update(log, BEGIN + dt.timedelta(hours=5))
    with monkeypatch.context() as m:
        m.setattr(R.LogRollup, "publish", lambda *_: (_ for _ in ()).throw(InterruptedError()))
        with pytest.raises(InterruptedError):
            rollup.update(log, BEGIN + dt.timedelta(hours=40))
    rollup.update(log, BEGIN + dt.timedelta(hours=40))
    assert counted(spark, rollup, log) == {k: expected(rows, *w) for k, w in WINDOWS.items()}


def test_a_long_window_is_few_buckets(spark, tmp_path):
    rows = log_rows(900)
    log, rollup = spark.createDataFrame(rows, SCHEMA), R.LogRollup(spark, str(tmp_path))
    rollup.update(log, BEGIN + dt.timedelta(days=20))
    later = log.filter(F.col("created_at") > F.lit(BEGIN + dt.timedelta(days=20)))  # the log before the mark is not needed
    start, end = (BEGIN + dt.timedelta(days=d) for d in (-9.0, 19.5))
    windows = spark.createDataFrame([("WEEKLY", start, end)], "frequency string, window_start timestamp, window_end timestamp")
    got = {(r.kind, r.target, r.event, r.change, r.actor): r.n for r in rollup.counted(later, windows).collect()}
    assert got == {k: v[0] for k, v in expected(rows, start, end).items()}


def test_sums_are_kept_without_collecting_lists(spark, tmp_path):
    at = BEGIN + dt.timedelta(seconds=30)
    edits = [["slug"], ["slug", "readme"], None, ["slug"], ["name"]]
    rows = [(i, at + dt.timedelta(seconds=i), 1, "E", None, 5, None, None, e) for i, e in enumerate(edits)]
    log, rollup = spark.createDataFrame(rows, SCHEMA), R.LogRollup(spark, str(tmp_path))
    assert rollup.update(log, BEGIN + dt.timedelta(hours=2)) == 3 * 2 * 4  # levels, targets, lists
    windows = spark.createDataFrame([("DAILY", BEGIN, BEGIN + dt.timedelta(hours=1))], "frequency string, window_start timestamp, window_end timestamp")
    parts = rollup.parts(log, windows)
    assert "collect_" not in parts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.kind, tuple(r.edited), r.n) for r in parts.collect()) == sorted(
        (kind, *x) for kind in ("catalog", "user") for x in (((), 1), (("name",), 1), (("slug",), 2), (("slug", "readme"), 1))
    )
    assert {r.kind: (r.n, r["first"].id, r.last_at, frozenset(r.edited)) for r in rollup.counted(log, windows).collect()} == {
        kind: (5, 0, at + dt.timedelta(seconds=4), frozenset({"slug", "readme", "name"})) for kind in ("catalog", "user")
    }


def test_follows_and_package_keys_are_worked_out_once(spark, tmp_path, monkeypatch):
    from sparcel.registry import notifications as N

    made = []
    for module in (R, N):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: made.append(name) or write(df, name))
    at = BEGIN + dt.timedelta(seconds=30)
    log = spark.createDataFrame([(i, at, a, "E", "A", None, None, 7, e) for i, (a, e) in enumerate([(1, ["slug"]), (1, ["name"]), (2, ["slug"])])], SCHEMA)
    follow = "user_id long, target_catalog_id long, target_collection_id long, target_user_id long, target_package_id long, event_types array<string>, change_types array<string>, follow_all_packages boolean, frequency string"
    follows = spark.createDataFrame([(3, None, None, None, 7, ["E"], ["A"], False, "DAILY"), (1, 4, None, None, None, ["E"], ["A"], True, "DAILY"), (2, None, None, 1, None, ["E"], [], False, "WEEKLY")], follow)
    packages = spark.createDataFrame([(7, 4)], "package_id long, catalog_id long")
    inside = spark.createDataFrame([(7, 9)], "package_id long, collection_id long")
    windows = spark.createDataFrame([("DAILY", BEGIN, BEGIN + dt.timedelta(hours=1))], "frequency string, window_start timestamp, window_end timestamp")
    rollup = R.LogRollup(spark, str(tmp_path))
    rollup.update(log, BEGIN + dt.timedelta(hours=2))
    rows = R.digests(rollup, log, follows, packages, inside, windows).select("kind", "user_id", "target_id", "n_actions", "n_actors", "first_actor_id", "properties_edited").collect()
    assert sorted(map(tuple, rows)) == [("package", 1, 7, 1, 1, 2, ["slug"]), ("package", 3, 7, 3, 2, 1, ["name", "slug"])]
    assert made.count("follows") == made.count("package_keys") == 1
