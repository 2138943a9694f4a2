"""Plans that matter at scale: pruned and filtered scans, no nested loops, one read of the log."""

import re

import pytest

from sparcel.checks import QUERIES
from sparcel.operators.profile import profile
from sparcel.operators.projection import after_offset



def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_reads_only_its_columns(spark, sf_dir):
    text = physical(profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), columns=["l_quantity", "l_tax"]))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<l_quantity:double,l_tax:double>"]


def test_offset_filter_reaches_the_scan(spark, sf_dir):
    text = physical(after_offset(spark.read.parquet(f"{sf_dir}/events.parquet"), 500, "event_id").select("event_id"))
    assert "GreaterThan(event_id,500)" in text


def test_feed_reads_the_log_once(spark, sf_dir):
    text = physical(QUERIES["following_feed"](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet.*events\.parquet", text)) == 1


def test_first_records_are_cut_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in physical(QUERIES["sample_records"](spark, sf_dir))
    assert "WindowGroupLimit" in physical(QUERIES["search_all_registries"](spark, sf_dir))
    assert "TakeOrderedAndProject" in physical(QUERIES["latest_packages"](spark, sf_dir))


NO_LOOPS = [
    "following_feed_all", "notify_by_package", "notification_actions", "visible_packages", "diff_properties", "diff_packages",
    "version_chain_diffs", "publish_check", "offset_filter", "search_index", "detect_person_name", "activity_enrich", "batch_scan",
    "sitemap_pages", "new_records_available",
]


@pytest.mark.parametrize("name", NO_LOOPS)
def test_no_nested_loop(name, spark, sf_dir):
    text = physical(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_shapes_are_compiled(spark, sf_dir):
    """Without the way back to interpreted rules, code that is too large would be an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("relational_shape", "document_shape", "warehouse_shape_prefixed", "exchange_normalize_kraken"):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_a_market_message_is_parsed_once(spark):
    from sparcel.sources import feeds

    texts = [
        '{"type":"update","channel":"trades","market":"M","data":[{"id":1,"price":1.50,"of":{"x":[1,2]}},5,null]}', '{"type":"update","channel":"ticker","market":"N","data":{"id":2}}',
        '{"type":"update","channel":"orders","market":"M","data":{"id":3}}', '{"type":"subscribed","channel":"ticker"}', "no message", None, '{"type":"update","channel":"trades","data":[]}',
    ]
    rows = feeds.normalize_ftx(spark.createDataFrame([(t,) for t in texts], "value string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    want = [("ticker", {"id": "2", "market": "N"}), ("trades", None), ("trades", None), ("trades", {"id": "1", "price": "1.5", "of": '{"x":[1,2]}', "market": "M"})]
    assert sorted(((r["_schema_slug"], r["record"]) for r in rows.collect()), key=lambda r: (r[0], len(r[1] or ()))) == want


def test_the_body_of_a_positional_message_is_read_once(spark):
    from sparcel.sources import feeds

    texts = [
        '[7,[["1.5","2",3,"b","l",""],5,null,["9"]],"trade","XBT"]', '[7,{"a":["1","2","3"],"b":"x","l":["4"],"q":["5"]},"ticker","XBT"]', '[7,["1",2],"spread","XBT"]', '[7,{},"ticker",null]',
        '[7,[],"trade","XBT"]', '[7,5,"spread","XBT"]', '[7,null,"ticker","XBT"]', '[7,["1"],"other","XBT"]', '{"event":"heartbeat"}', "no message", None,
    ]
    rows = feeds.normalize_kraken(spark.createDataFrame([(t,) for t in texts], "value string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("parseJson"), plan.count("try_variant_get")) == (1, 5)  # channel, pair and a body for each channel
    want = [
        ("spread", {"bid": "1", "ask": "2"}), ("ticker", {}), ("ticker", {"pair": "XBT", "ask_price": "1", "ask_whole_lot_volume": "2", "ask_lot_volume": "3", "low_today": "4"}),
        ("trade", {"pair": "XBT", "price": "9"}), ("trade", {"pair": "XBT", "price": "1.5", "volume": "2", "time": "3", "side": "b", "orderType": "l", "misc": ""}),
    ]
    assert sorted(((r["_schema_slug"], r["record"]) for r in rows.collect()), key=lambda r: (r[0], len(r[1]))) == want


@pytest.mark.parametrize("name", ["upgrade_descriptors", "normalize_ftx"])
def test_costly_rows_of_one_row_group_go_to_all_cores(spark, tmp_path, monkeypatch, name):
    from sparcel.checks import QUERIES, delivery, plans

    tables = {
        "customer": "SELECT id AS c_custkey, concat('c', id) AS c_name, CAST(id % 25 AS int) AS c_nationkey, 1D AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(60)",
        "orders": "SELECT id AS o_orderkey, 2.5D AS o_totalprice FROM range(60)", "region": "SELECT 1 AS r_regionkey",
        "lineitem": "SELECT id AS l_orderkey, 1 AS l_linenumber, 3.5D AS l_extendedprice, 0.5D AS l_tax FROM range(60)",
    }
    for table, sql in tables.items():
        spark.sql(sql).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    module, query = {"upgrade_descriptors": (plans.U, "upgrade_descriptors"), "normalize_ftx": (delivery.feeds, "exchange_normalize_ftx")}[name]
    parts, plain = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df: parts.append(df.rdd.getNumPartitions()) or plain(df))
    cores = spark.sparkContext.defaultParallelism
    assert QUERIES[query](spark, str(tmp_path)).count() == {"upgrade_descriptors": 60, "normalize_ftx": 180}[name]
    assert parts[0] >= {"upgrade_descriptors": cores, "normalize_ftx": 2 * cores}[name]
