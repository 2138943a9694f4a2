"""Activity log: views, feeds, followers, counters.

Activity rows: ``id, created_at, user_id, event_type, change_type, target_package_id,
target_catalog_id, target_collection_id, target_package_issue_id, properties_edited``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT = 1000
VERSION_CREATED = "VERSION_CREATED"
#: what a follow can point at: follow column -> activity column
TARGETS = {
    "target_user_id": "user_id",
    "target_collection_id": "target_collection_id",
    "target_catalog_id": "target_catalog_id",
    "target_package_issue_id": "target_package_issue_id",
    "target_package_id": "target_package_id",
}


def newest_first(df: DataFrame) -> list[Column]:
    return [F.col("created_at").desc(), F.col("id").desc()]


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def recently_viewed(
    activity: DataFrame, user: int, event_type: str, target: str, limit: int, offset: int = 0
) -> DataFrame:
    """Latest view of each target among a user's last 1000 views, newest first.

    The last views come from a top-k, so at most 1000 rows are grouped.
    """
    views = activity.filter((F.col("user_id") == user) & (F.col("event_type") == event_type) & F.col(target).isNotNull())
    last = views.orderBy(*newest_first(views)).limit(RECENT)
    rest = [c for c in last.columns if c != target]
    latest = last.groupBy(target).agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("v"))
    rows = latest.select(target, "v.*").select(*last.columns)
    return page(rows.orderBy(*newest_first(rows)), limit, offset)


def recently_viewed_non_empty(
    activity: DataFrame, contents: DataFrame, user: int, event_type: str, target: str, key: str, limit: int, offset: int = 0
) -> DataFrame:
    """The same for collections that hold something."""
    viewed = recently_viewed(activity, user, event_type, target, RECENT)
    kept = viewed.join(contents.select(F.col(key).alias(target)).distinct(), target, "left_semi")
    return page(kept.orderBy(*newest_first(kept)), limit, offset)


def _followed(follows: DataFrame, target: Column) -> DataFrame:
    """(target, event type) keys with the change types of the follows behind them."""
    keys = follows.filter(target.isNotNull()).select(
        target.alias("_target"), F.explode("event_types").alias("_event"), F.coalesce("change_types", F.array().cast("array<string>")).alias("_c")
    )
    return keys.select("_target", "_event", F.explode_outer("_c").alias("_c")).groupBy("_target", "_event").agg(
        F.collect_set("_c").alias("_changes")
    )


def following_feed(
    activity: DataFrame, follows: DataFrame, packages: DataFrame, collection_packages: DataFrame, user: int,
    hidden: Mapping[str, DataFrame] | None = None, limit: int | None = 20, offset: int = 0,
) -> DataFrame:
    """Activity of what a user follows, newest first, without their own and without the invisible.

    The log is read once. Each way of following becomes a small table of distinct
    (target, event type) keys joined to it, so rows never multiply and nothing is
    de-duplicated afterwards. ``hidden`` maps a target column to a table ``(target)`` of what
    the user may not see.
    """
    mine = follows.filter(F.col("user_id") == user)
    in_catalog = mine.filter(F.col("target_catalog_id").isNotNull()).join(
        packages.select("package_id", F.col("catalog_id").alias("target_catalog_id")), "target_catalog_id"
    )
    in_collection = mine.filter(F.col("target_collection_id").isNotNull()).join(
        collection_packages.select("package_id", F.col("collection_id").alias("target_collection_id")), "target_collection_id"
    )
    inside = in_catalog.unionByName(in_collection)
    ways = {name: (_followed(mine, F.col(name)), column, None) for name, column in TARGETS.items()}
    ways["_all_packages"] = (_followed(inside.filter("follow_all_packages"), F.col("package_id")), "target_package_id", None)
    ways["_all_issues"] = (
        _followed(inside.filter("follow_all_package_issues"), F.col("package_id")), "target_package_id", "target_package_issue_id",
    )
    log = activity.filter(F.col("user_id") != user)
    columns = log.columns
    changes = F.col("target_package_id").isNull() | (F.col("event_type") != VERSION_CREATED)
    shown = F.lit(False)
    for number, (keys, column, needed) in enumerate(ways.values()):
        mark = f"_w{number}"
        side = keys.select(F.col("_target").alias(f"{mark}_t"), F.col("_event").alias(f"{mark}_e"), F.col("_changes").alias(mark))
        log = log.join(side, (F.col(column) == F.col(f"{mark}_t")) & (F.col("event_type") == F.col(f"{mark}_e")), "left")
        hit = F.col(mark).isNotNull() & (changes | F.coalesce(F.array_contains(mark, F.col("change_type")), F.lit(False)))
        shown = shown | (hit & F.col(needed).isNotNull() if needed else hit)
    feed = log.filter(shown).select(*columns)
    for column, unseen in (hidden or {}).items():
        feed = feed.join(unseen.select(column).distinct(), column, "left_anti").select(*columns)
    return feed if limit is None else page(feed.orderBy(*newest_first(feed)), limit, offset)


def followers(follows: DataFrame, target: str, value: int, users: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Distinct users who follow one target, oldest follow first."""
    first = follows.filter(F.col(target) == value).groupBy("user_id").agg(F.min("created_at").alias("created_at"))
    rows = first.join(users, "user_id")
    return page(rows.orderBy("created_at", "user_id"), limit, offset)


def follower_counts(follows: DataFrame, target: str) -> DataFrame:
    """Distinct followers of every target; a target with very many is counted in two steps."""
    pairs = follows.filter(F.col(target).isNotNull()).select(target, "user_id").distinct()
    return pairs.groupBy(target).agg(F.count("*").alias("followers"))


def activity_filter(
    activity: DataFrame, *, limit: int, offset: int = 0, event_types: Iterable[str] = (), **targets: int
) -> tuple[DataFrame, DataFrame]:
    """(page newest first, one row with ``count`` and ``has_more``)."""
    kept = activity
    for column, value in targets.items():
        kept = kept.filter(F.col(column) == value)
    types = list(event_types)
    if types:
        kept = kept.filter(F.col("event_type").isin(types))
    total = kept.agg(F.count("*").alias("count")).withColumn("has_more", F.col("count") - (limit + offset) > 0)
    return page(kept.orderBy(*newest_first(kept)), limit, offset), total


def activity_enrich(activity: DataFrame, lookups: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Names for ids. ``lookups``: activity column -> (table, its key, its name column)."""
    for column, (table, key, name) in lookups.items():
        side = table.select(F.col(key).alias(f"_{column}"), F.col(name).alias(f"{column.removesuffix('_id')}_name"))
        activity = activity.join(side, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
    return activity


def usage_counters(activity: DataFrame, target: str, events: Mapping[str, str]) -> DataFrame:
    """Counts per target: ``events`` maps a counter to the event type it counts."""
    return activity.filter(F.col(target).isNotNull()).groupBy(target).agg(
        *[F.count_if(F.col("event_type") == event).alias(name) for name, event in events.items()]
    )
