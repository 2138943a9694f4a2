"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run in full into a sink that discards its rows.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sparcel.checks import QUERIES  # noqa: E402
from sparcel.session import local_session, release  # noqa: E402

HEADLINE = (
    "profile_table", "profile_counts", "profile_strings", "value_options", "merge_profiles", "infer_string_type",
    "scan_content_labels", "detect_person_name_in_text", "relational_shape", "cast_to_string", "csv_typed_scan",
    "json_path_scan", "exchange_normalize_kraken", "batch_upload", "batch_scan", "sink_state_upsert", "diff_properties",
    "version_chain_diffs", "publish_check", "upgrade_descriptors", "following_feed", "notify_by_package",
    "notification_digest", "visible_packages", "search_documents", "text_index_refresh", "search_all_registries",
    "latest_version", "sitemap_pages", "usage_counters", "continuous_ingest", "stream_profile",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="sparcel-bench")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        release(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
