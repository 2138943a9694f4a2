"""Notifications: what happened to followed targets in a period.

The log is added up by target, event and actor before it meets the followers, and what a follower did is taken off their totals
again, so a popular target costs its followers plus its actors. Single actions are listed for one user at a time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.session import written

# Seconds per frequency, and the edits that are announced.
PERIOD_SECONDS = {"INSTANT": 60, "HOURLY": 3600, "DAILY": 86_400, "WEEKLY": 7 * 86_400, "MONTHLY": 30 * 86_400}
ALERTABLE = ("description", "displayName", "slug")
ORDER = ("kind", "user_id", "target_id", "event_type", "created_at", "id")


def notification_window(frequencies: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """(frequency, window_start, window_end): the stored mark, else one period back from ``now``."""
    seconds = F.create_map(*[x for k, v in PERIOD_SECONDS.items() for x in (F.lit(k), F.lit(v))])
    back = F.timestamp_seconds(F.unix_timestamp(now) - F.try_element_at(seconds, F.col("frequency")))
    return frequencies.join(state.select("frequency", "last_notified"), "frequency", "left").select(
        "frequency", F.coalesce(F.col("last_notified").cast("timestamp"), back).alias("window_start"), now.alias("window_end")
    )


def _period(activity: DataFrame, start: dt.datetime | Column, end: dt.datetime | Column) -> DataFrame:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return activity.filter((F.col("created_at") > as_col(start)) & (F.col("created_at") <= as_col(end)))


def _keys(follows: DataFrame, target: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(_follower, _target, _event, _changes): what each follow asks for; no change types stand for all. ``also`` are columns kept apart."""
    return follows.filter(F.col(target).isNotNull()).select(
        *also, F.col("user_id").alias("_follower"), F.col(target).alias("_target"), F.explode(F.array_distinct("event_types")).alias("_event"),
        F.lit(None).cast("array<string>").alias("_changes"),
    ).distinct()


def _package_keys(follows: DataFrame, packages: DataFrame, collection_packages: DataFrame, acted: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The same for packages: followed ones, and those of followed catalogs and collections.

    Following everything inside only announces the change types of the follow. Only packages of ``acted`` (``_target``,
    ``_event``) are listed, instead of every package that is followed; a follower has one row for each of them.
    """
    direct = _keys(follows, "target_package_id", also)
    every = follows.filter("follow_all_packages")
    parts = [direct]
    for owner, column, bridge in (("target_catalog_id", "catalog_id", packages), ("target_collection_id", "collection_id", collection_packages)):
        inside = acted.join(bridge.select(F.col("package_id").alias("_target"), F.col(column).alias("_owner")).distinct(), "_target")
        wanted = every.filter(F.col(owner).isNotNull()).select(
            *also, F.col("user_id").alias("_follower"), F.col(owner).alias("_owner"), F.explode(F.array_distinct("event_types")).alias("_event"),
            F.col("change_types").alias("_changes"),
        )
        parts.append(inside.join(wanted, [*also, "_owner", "_event"]).select(*also, "_follower", "_target", "_event", F.coalesce("_changes", F.array().cast("array<string>")).alias("_changes")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy(*also, "_follower", "_target", "_event").agg(
        F.max(F.col("_changes").isNull()).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_changes")))).alias("_some")
    ).select(*also, "_follower", "_target", "_event", F.when(~F.col("_all"), F.col("_some")).alias("_changes"))


def _counted(log: DataFrame, target: str) -> DataFrame:
    """The log by target, event, change type and actor: count, first and last action, edited properties."""
    return log.filter(F.col(target).isNotNull()).groupBy(
        F.col(target).alias("_target"), F.col("event_type").alias("_event"), F.col("change_type").alias("_change"), F.col("user_id").alias("actor_id")
    ).agg(
        F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("first"), F.max("created_at").alias("last_at"),
        F.array_distinct(F.flatten(F.collect_set("properties_edited"))).alias("edited"),
    )


def _summaries(kind: str, counted: DataFrame, keys: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per follow and event type, without the follower's own actions.

    Followers that ask for the same change types of a target share one set of totals. The totals keep the first two actors
    and the last two, and of an edited property how many actors edited it, so one's own share can be taken off again: the work
    follows the followers and the actors, not their pairs. All actions without an actor count as those of one unknown actor.
    """
    group = [*also, "_target", "_event", "_asked"]
    keys = keys.withColumn("_asked", F.coalesce(F.array_join("_changes", ","), F.lit("*")))
    asked = keys.select(*group, "_changes").distinct()
    by_actor = counted.join(asked, [*also, "_target", "_event"]).filter(F.col("_changes").isNull() | F.array_contains("_changes", F.col("_change")))
    by_actor = written(by_actor.groupBy(*group, "actor_id").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last_at").alias("last_at"), F.array_distinct(F.flatten(F.collect_list("edited"))).alias("edited"),
    ), f"{kind}_actors")
    first, last = F.struct("first", "actor_id"), F.struct("last_at", "actor_id")
    totals = by_actor.groupBy(*group).agg(F.sum("n").alias("total"), F.count("*").alias("actors"), F.min(first).alias("first1"), F.max(last).alias("last1"))
    totals = written(totals, f"{kind}_totals")
    others = by_actor.join(totals, group).groupBy(*group).agg(
        F.min(F.when(~F.col("actor_id").eqNullSafe(F.col("first1.actor_id")), first)).alias("first2"), F.max(F.when(~F.col("actor_id").eqNullSafe(F.col("last1.actor_id")), last)).alias("last2")
    )
    edits = by_actor.select(*group, "actor_id", F.explode("edited").alias("p")).groupBy(*group, "p").agg(F.count("*").alias("k"), F.max("actor_id").alias("only"))
    edits = edits.groupBy(*group).agg(F.collect_list(F.struct("p", "k", "only")).alias("edits"))
    totals = totals.join(others, group).join(edits, group, "left")
    own = by_actor.select(*group, F.col("actor_id").alias("_follower"), F.col("n").alias("own"))
    rows = keys.drop("_changes").join(totals, group).join(own, [*group, "_follower"], "left")
    begins = F.when(F.col("first1.actor_id") == F.col("_follower"), F.col("first2")).otherwise(F.col("first1"))
    ends = F.when(F.col("last1.actor_id") == F.col("_follower"), F.col("last2")).otherwise(F.col("last1"))
    edited = F.filter("edits", lambda e: (e["k"] > 1) | ~e["only"].eqNullSafe(F.col("_follower")))
    return rows.filter(F.col("actors") > F.when(F.col("own").isNull(), 0).otherwise(1)).select(
        *also, F.lit(kind).alias("kind"), F.col("_follower").alias("user_id"), F.col("_target").alias("target_id"), F.col("_event").alias("event_type"),
        (F.col("total") - F.coalesce("own", F.lit(0))).alias("n_actions"), (F.col("actors") - F.when(F.col("own").isNull(), 0).otherwise(1)).alias("n_actors"),
        begins["first"]["created_at"].alias("first_at"), ends["last_at"].alias("last_at"), begins["actor_id"].alias("first_actor_id"),
        F.coalesce(F.array_sort(F.transform(edited, lambda e: e["p"])), F.array().cast("array<string>")).alias("properties_edited"),
    )


def notify_by_catalog(activity, follows, start, end, frequency) -> DataFrame:
    wanted = follows.filter(F.col("frequency") == frequency)
    return _summaries("catalog", _counted(_period(activity, start, end), "target_catalog_id"), _keys(wanted, "target_catalog_id"))


def notify_by_collection(activity, follows, start, end, frequency) -> DataFrame:
    wanted = follows.filter(F.col("frequency") == frequency)
    return _summaries("collection", _counted(_period(activity, start, end), "target_collection_id"), _keys(wanted, "target_collection_id"))


def notify_by_user(activity, follows, start, end, frequency) -> DataFrame:
    wanted = follows.filter(F.col("frequency") == frequency)
    return _summaries("user", _counted(_period(activity, start, end), "user_id"), _keys(wanted, "target_user_id"))


def notify_by_package(activity, follows, packages, collection_packages, start, end, frequency) -> DataFrame:
    """Followed packages, and all packages of followed catalogs and collections."""
    wanted = follows.filter(F.col("frequency") == frequency)
    counted = written(_counted(_period(activity, start, end), "target_package_id"), "package_log")
    acted = counted.filter(F.col("_change").isNotNull()).select("_target", "_event").distinct()
    return _summaries("package", counted, _package_keys(wanted, packages, collection_packages, acted))


def summaries_of(counted: DataFrame, follows: DataFrame, packages: DataFrame, collection_packages: DataFrame, also: tuple[str, ...] = ("frequency",)) -> DataFrame:
    """The summaries of all four kinds and every frequency, from sums by ``kind`` and ``frequency``; an actor may have several."""
    keys = {kind: _keys(follows, target, also) for kind, target in (("catalog", "target_catalog_id"), ("collection", "target_collection_id"), ("user", "target_user_id"))}
    of = {kind: counted.filter(F.col("kind") == kind).drop("kind") for kind in (*keys, "package")}
    acted = of["package"].filter(F.col("_change").isNotNull()).select(*also, "_target", "_event").distinct()
    keys["package"] = written(_package_keys(follows, packages, collection_packages, acted, also), "package_keys")  # for the totals and for the followers
    out = None
    for kind, rows in of.items():
        found = _summaries(kind, rows, keys[kind], also)
        out = found if out is None else out.unionByName(found)
    return out


def actions_of(activity, follows, packages, collection_packages, start, end, frequency, user: int) -> DataFrame:
    """Every single action that one user is told about, in the order of a message."""
    wanted = follows.filter((F.col("frequency") == frequency) & (F.col("user_id") == user))
    log = _period(activity, start, end).filter(F.col("user_id") != user)
    seen = log.filter(F.col("target_package_id").isNotNull() & F.col("change_type").isNotNull())
    acted = seen.select(F.col("target_package_id").alias("_target"), F.col("event_type").alias("_event")).distinct()
    out = []
    for kind, target, keys in (
        ("catalog", "target_catalog_id", _keys(wanted, "target_catalog_id")), ("collection", "target_collection_id", _keys(wanted, "target_collection_id")),
        ("user", "user_id", _keys(wanted, "target_user_id")), ("package", "target_package_id", _package_keys(wanted, packages, collection_packages, acted)),
    ):
        rows = log.join(keys, (F.col(target) == F.col("_target")) & (F.col("event_type") == F.col("_event")))
        rows = rows.filter(F.col("_changes").isNull() | F.array_contains("_changes", F.col("change_type")))
        out.append(rows.select(
            F.lit(kind).alias("kind"), F.col("_follower").alias("user_id"), F.col("_target").alias("target_id"), "event_type", "created_at", "id", F.col("user_id").alias("actor_id"),
        ))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).orderBy(*ORDER)


def notification_digest(summaries: DataFrame) -> DataFrame:
    """Per user: actions and targets of each kind of follow, all four together."""
    kinds = ("catalog", "collection", "package", "user")
    return summaries.groupBy("user_id").agg(
        F.sum("n_actions").alias("n_actions"),
        F.count("*").alias("n_entries"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n_actions")).otherwise(0)).alias(f"{k}_actions") for k in kinds],
    )


def actor_text(name: Column, n_actors: Column) -> Column:
    """``X and N other users``; a single other user is not mentioned."""
    others = n_actors - 1
    return F.when(others > 1, F.concat(name, F.lit(" and "), others.cast("string"), F.lit(" other users"))).otherwise(name)


def edit_text(properties: Column) -> Column:
    """``edited a, b`` with the announced properties only."""
    shown = F.filter(properties, lambda p: p.isin(*ALERTABLE))
    return F.concat(F.lit("edited "), F.array_join(shown, ", "))


def notification_text(summaries: DataFrame, users: DataFrame, edit_event: str = "PACKAGE_EDIT") -> DataFrame:
    """Add ``actor`` and ``action`` texts; ``users`` is (user_id, display_name)."""
    named = summaries.join(
        users.select(F.col("user_id").alias("first_actor_id"), F.col("display_name")), "first_actor_id", "left"
    )
    action = F.when(F.col("event_type") == edit_event, edit_text(F.col("properties_edited"))).otherwise(
        F.lower(F.replace("event_type", F.lit("_"), F.lit(" ")))
    )
    return named.select(
        "kind", "user_id", "target_id", "event_type", "n_actions",
        actor_text(F.col("display_name"), F.col("n_actors")).alias("actor"), action.alias("action"),
    )
