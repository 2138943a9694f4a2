"""Registry questions: feeds, notifications, visibility, search, listings."""

from __future__ import annotations

import datetime as dt
import re
import uuid

from pyspark.sql import functions as F

from sparcel.checks.base import dealt, register, spark_sql, standin, table
from sparcel.registry import activity as A
from sparcel.registry import listings as G
from sparcel.registry import notifications as N
from sparcel.registry import search as Q
from sparcel.registry import visibility as Z
from sparcel.registry.prefixes import write_prefixes
from sparcel.registry.rollup import LogRollup, digests
from sparcel.registry.segments import SegmentIndex
from sparcel.session import scratch, shared_dir

GRANTS = ("user_catalog", "user_package", "group_user", "group_package", "group_catalog", "user_collection", "group_collection")


def _grants(spark, sf):
    return {name: standin(spark, sf, name) for name in GRANTS}


RECENT = """SELECT id, created_at, {t} FROM (SELECT *, row_number() OVER (PARTITION BY {t} ORDER BY created_at DESC, id DESC) AS rk FROM (
  SELECT * FROM {{activity}} a WHERE user_id = 7 AND event_type = '{e}' AND {t} IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 1000) l) r WHERE rk = 1"""


@register("recently_viewed", RECENT.format(t="target_package_id", e="PACKAGE_VIEWED") + " ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 2")
def recently_viewed(spark, sf):
    rows = A.recently_viewed(standin(spark, sf, "activity"), 7, "PACKAGE_VIEWED", "target_package_id", 20, 2)
    return rows.select("id", "created_at", "target_package_id")


@register(
    "recently_viewed_non_empty",
    f"SELECT * FROM ({RECENT.format(t='target_collection_id', e='COLLECTION_VIEWED')}) v WHERE target_collection_id IN (SELECT collection_id FROM {{collection_packages}} c) ORDER BY created_at DESC, id DESC LIMIT 20",
)
def recently_viewed_non_empty(spark, sf):
    rows = A.recently_viewed_non_empty(
        standin(spark, sf, "activity"), standin(spark, sf, "collection_packages"), 7, "COLLECTION_VIEWED", "target_collection_id", "collection_id", 20
    )
    return rows.select("id", "created_at", "target_collection_id")


FEED = """SELECT DISTINCT a.id, a.created_at, a.event_type FROM {activity} a JOIN (SELECT * FROM {follows} f0 WHERE user_id = %d) f ON a.user_id <> f.user_id AND list_contains(f.event_types, a.event_type)
  AND (a.user_id = f.target_user_id OR a.target_collection_id = f.target_collection_id OR a.target_catalog_id = f.target_catalog_id
    OR a.target_package_issue_id = f.target_package_issue_id OR a.target_package_id = f.target_package_id
    OR (f.follow_all_package_issues AND a.target_package_issue_id IS NOT NULL AND (a.target_package_id IN (SELECT package_id FROM {packages} p WHERE p.catalog_id = f.target_catalog_id)
      OR a.target_package_id IN (SELECT package_id FROM {collection_packages} c WHERE c.collection_id = f.target_collection_id)))
    OR (f.follow_all_packages AND (a.target_package_id IN (SELECT package_id FROM {packages} p WHERE p.catalog_id = f.target_catalog_id)
      OR a.target_package_id IN (SELECT package_id FROM {collection_packages} c WHERE c.collection_id = f.target_collection_id))))
  AND (a.target_package_id IS NULL OR a.event_type <> 'VERSION_CREATED' OR list_contains(f.change_types, a.change_type))
  WHERE (a.target_package_id IS NULL OR a.target_package_id NOT IN (SELECT package_id FROM {packages} h WHERE NOT is_public AND creator_id <> %d))"""


@register("following_feed", FEED % (12, 12) + " ORDER BY a.created_at DESC, a.id DESC LIMIT 50 OFFSET 10")
def following_feed(spark, sf):
    packages = standin(spark, sf, "packages")
    unseen = packages.filter(~F.col("is_public") & (F.col("creator_id") != 12)).select(F.col("package_id").alias("target_package_id"))
    feed = A.following_feed(
        standin(spark, sf, "activity"), standin(spark, sf, "follows"), packages, standin(spark, sf, "collection_packages"), 12,
        hidden={"target_package_id": unseen}, limit=50, offset=10,
    )
    return feed.select("id", "created_at", "event_type")


@register("following_feed_all", FEED % (33, 33))
def following_feed_all(spark, sf):
    packages = standin(spark, sf, "packages")
    unseen = packages.filter(~F.col("is_public") & (F.col("creator_id") != 33)).select(F.col("package_id").alias("target_package_id"))
    feed = A.following_feed(
        standin(spark, sf, "activity"), standin(spark, sf, "follows"), packages, standin(spark, sf, "collection_packages"), 33,
        hidden={"target_package_id": unseen}, limit=None,
    )
    return feed.select("id", "created_at", "event_type")


START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
PERIOD = "a.created_at > TIMESTAMP '2024-01-05 00:00:00' AND a.created_at <= TIMESTAMP '2024-01-20 00:00:00'"


def _actions_sql(kind: str, follow: str, log: str) -> str:
    return f"""SELECT DISTINCT '{kind}' AS kind, f.user_id, f.{follow} AS target_id, a.event_type, a.created_at, a.id, a.user_id AS actor_id, a.properties_edited
      FROM {{activity}} a JOIN {{follows}} f ON a.{log} = f.{follow} AND list_contains(f.event_types, a.event_type) AND a.user_id <> f.user_id
      WHERE {PERIOD} AND f.frequency = 'DAILY'"""


PACKAGE_ACTIONS = f"""SELECT DISTINCT 'package' AS kind, f.user_id, a.target_package_id AS target_id, a.event_type, a.created_at, a.id, a.user_id AS actor_id, a.properties_edited
  FROM {{activity}} a JOIN {{follows}} f ON list_contains(f.event_types, a.event_type) AND a.user_id <> f.user_id AND (a.target_package_id = f.target_package_id
    OR (f.follow_all_packages AND list_contains(f.change_types, a.change_type) AND (a.target_package_id IN (SELECT package_id FROM {{packages}} p WHERE p.catalog_id = f.target_catalog_id)
      OR a.target_package_id IN (SELECT package_id FROM {{collection_packages}} c WHERE c.collection_id = f.target_collection_id))))
  WHERE {PERIOD} AND f.frequency = 'DAILY' AND a.target_package_id IS NOT NULL"""
ACTIONS = {
    "catalog": _actions_sql("catalog", "target_catalog_id", "target_catalog_id"),
    "collection": _actions_sql("collection", "target_collection_id", "target_collection_id"),
    "user": _actions_sql("user", "target_user_id", "user_id"),
    "package": PACKAGE_ACTIONS,
}


def _summary_sql(actions: str) -> str:
    return f"""SELECT kind, user_id, target_id, event_type, count(*) AS n_actions, count(DISTINCT actor_id) AS n_actors, min(created_at) AS first_at, max(created_at) AS last_at,
      arg_min(actor_id, (created_at, id)) AS first_actor_id,
      coalesce(array_to_string(list_sort(list_distinct(flatten(list(properties_edited) FILTER (WHERE properties_edited IS NOT NULL)))), ','), '') AS edited
      FROM ({actions}) x GROUP BY 1, 2, 3, 4"""


def _notified(spark, sf, kind):
    activity, follows = standin(spark, sf, "activity"), standin(spark, sf, "follows")
    if kind == "package":
        return N.notify_by_package(activity, follows, standin(spark, sf, "packages"), standin(spark, sf, "collection_packages"), START, END, "DAILY")
    return {"catalog": N.notify_by_catalog, "collection": N.notify_by_collection, "user": N.notify_by_user}[kind](activity, follows, START, END, "DAILY")


def _register_notify(kind):
    @register(f"notify_by_{kind}", _summary_sql(ACTIONS[kind]))
    def query(spark, sf):
        return _notified(spark, sf, kind).withColumn("edited", F.array_join("properties_edited", ",")).drop("properties_edited")


for _kind in ACTIONS:
    _register_notify(_kind)


@register("notification_actions", "SELECT kind, user_id, target_id, event_type, created_at, id, actor_id FROM (" + " UNION ALL ".join(ACTIONS.values()) + ") x WHERE user_id = 5")
def notification_actions(spark, sf):
    tables = [standin(spark, sf, t) for t in ("activity", "follows", "packages", "collection_packages")]
    return N.actions_of(*tables, START, END, "DAILY", 5)


ALL_SUMMARIES = " UNION ALL ".join(_summary_sql(a) for a in ACTIONS.values())


def _summaries(spark, sf):
    out = None
    for kind in ACTIONS:
        rows = _notified(spark, sf, kind)
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "notification_digest",
    "SELECT user_id, CAST(sum(n_actions) AS BIGINT) AS n_actions, count(*) AS n_entries, "
    + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN n_actions ELSE 0 END) AS BIGINT) AS {k}_actions" for k in ACTIONS)
    + f" FROM ({ALL_SUMMARIES}) s GROUP BY 1",
)
def notification_digest(spark, sf):
    return N.notification_digest(_summaries(spark, sf))


# Windows of all frequencies: the stored mark of one, a period back from the end for the rest.
_STARTS = {"INSTANT": "2024-01-19 23:59:00", "HOURLY": "2024-01-19 23:00:00", "DAILY": "2024-01-05 07:11:13", "WEEKLY": "2024-01-13 00:00:00", "MONTHLY": "2023-12-21 00:00:00"}
_IN_WINDOW = "CASE f.frequency " + " ".join(f"WHEN '{k}' THEN a.created_at > TIMESTAMP '{v}'" for k, v in _STARTS.items()) + " END AND a.created_at <= TIMESTAMP '2024-01-20 00:00:00'"
_EVERY = {k: v.replace(f"{PERIOD} AND f.frequency = 'DAILY'", _IN_WINDOW).replace("SELECT DISTINCT", "SELECT DISTINCT f.frequency,") for k, v in ACTIONS.items()}


@register(
    "notification_digest_all",
    "SELECT frequency, user_id, CAST(sum(n_actions) AS BIGINT) AS n_actions, CAST(sum(n_actors) AS BIGINT) AS n_actors, count(*) AS n_entries, strftime(min(first_at), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(last_at), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM ("
    + " UNION ALL ".join(_summary_sql(a).replace("SELECT kind", "SELECT frequency, kind").replace("GROUP BY 1, 2, 3, 4", "GROUP BY 1, 2, 3, 4, 5") for a in _EVERY.values()) + ") s GROUP BY 1, 2",
)
def notification_digest_all(spark, sf):
    """Digests of all frequencies from sums by minute, hour and day that are brought up to date in two steps."""
    activity, follows = standin(spark, sf, "activity"), standin(spark, sf, "follows")
    rollup = LogRollup(spark, scratch(spark, "rollup"))
    for until in (dt.datetime(2024, 1, 10, 11, 30, 30), END):
        rollup.update(activity, until)
    now = F.lit(END).cast("timestamp")
    frequencies = spark.createDataFrame([(k,) for k in _STARTS], "frequency string")
    state = spark.createDataFrame([("DAILY", dt.datetime(2024, 1, 5, 7, 11, 13))], "frequency string, last_notified timestamp")
    rows = digests(rollup, activity, follows, standin(spark, sf, "packages"), standin(spark, sf, "collection_packages"), N.notification_window(frequencies, state, now))
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rows.groupBy("frequency", "user_id").agg(
        F.sum("n_actions").alias("n_actions"), F.sum("n_actors").alias("n_actors"), F.count("*").alias("n_entries"),
        F.date_format(F.min("first_at"), form).alias("first_at"), F.date_format(F.max("last_at"), form).alias("last_at"),
    )


@register(
    "notification_text",
    f"""SELECT kind, s.user_id, target_id, event_type, n_actions, CASE WHEN n_actors > 2 THEN u.display_name || ' and ' || (n_actors - 1) || ' other users' ELSE u.display_name END AS actor,
      CASE WHEN event_type = 'PACKAGE_EDIT' THEN 'edited ' || array_to_string(list_filter(string_split(edited, ','), lambda p: p IN ('description', 'displayName', 'slug')), ', ')
        ELSE lower(replace(event_type, '_', ' ')) END AS action FROM ({ALL_SUMMARIES}) s LEFT JOIN {{users}} u ON u.user_id = s.first_actor_id""",
)
def notification_text(spark, sf):
    return N.notification_text(_summaries(spark, sf), standin(spark, sf, "users"))


@register(
    "notification_window",
    """SELECT frequency, CASE WHEN frequency = 'DAILY' THEN '2024-01-30 00:00:00' WHEN frequency = 'WEEKLY' THEN strftime(newest - INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S')
      ELSE strftime(newest - INTERVAL 60 SECOND, '%Y-%m-%d %H:%M:%S') END AS window_start FROM (SELECT DISTINCT frequency FROM {follows} f) CROSS JOIN (SELECT max(ts) AS newest FROM events)""",
)
def notification_window(spark, sf):
    newest = table(spark, sf, "events").agg(F.max("ts")).first()[0]
    frequencies = standin(spark, sf, "follows").select("frequency").distinct()
    state = frequencies.filter("frequency = 'DAILY'").withColumn("last_notified", F.lit(dt.datetime(2024, 1, 30)))
    rows = N.notification_window(frequencies, state, F.lit(newest).cast("timestamp"))
    return rows.select("frequency", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"))


VISIBLE = """SELECT package_id FROM {packages} p WHERE is_public OR catalog_id IN (SELECT catalog_id FROM {user_catalog} u WHERE user_id = 7 AND list_contains(permissions, 'VIEW'))
  OR package_id IN (SELECT package_id FROM {user_package} u WHERE user_id = 7 AND list_contains(permissions, 'VIEW'))
  OR package_id IN (SELECT package_id FROM {group_package} g WHERE list_contains(permissions, 'VIEW') AND group_id IN (SELECT group_id FROM {group_user} u WHERE user_id = 7))
  OR catalog_id IN (SELECT catalog_id FROM {group_catalog} g WHERE list_contains(permissions, 'VIEW') AND group_id IN (SELECT group_id FROM {group_user} u WHERE user_id = 7))"""


@register("visible_packages", VISIBLE)
def visible_packages(spark, sf):
    return Z.visible_packages(standin(spark, sf, "packages"), _grants(spark, sf), 7).select("package_id")


VISIBLE_COLLECTIONS = """SELECT collection_id, name FROM {collections} c WHERE is_public OR collection_id IN (SELECT collection_id FROM {user_collection} u WHERE user_id = 7 AND list_contains(permissions, 'VIEW'))
  OR collection_id IN (SELECT collection_id FROM {group_collection} g WHERE list_contains(permissions, 'VIEW') AND group_id IN (SELECT group_id FROM {group_user} u WHERE user_id = 7))"""


@register("visible_collections", VISIBLE_COLLECTIONS)
def visible_collections(spark, sf):
    return Z.visible_collections(standin(spark, sf, "collections"), _grants(spark, sf), 7).select("collection_id", "name")


VISIBLE_CATALOGS = """SELECT catalog_id FROM {catalogs} c WHERE is_public OR catalog_id IN (SELECT catalog_id FROM {user_catalog} u WHERE user_id = 7 AND list_contains(catalog_permissions, 'VIEW'))
  OR catalog_id IN (SELECT catalog_id FROM {group_catalog} g WHERE list_contains(catalog_permissions, 'VIEW') AND group_id IN (SELECT group_id FROM {group_user} u WHERE user_id = 7))"""


@register("visible_catalogs", VISIBLE_CATALOGS)
def visible_catalogs(spark, sf):
    return Z.visible_catalogs(standin(spark, sf, "catalogs"), _grants(spark, sf), 7).select("catalog_id")


@register("visible_catalogs_anonymous", "SELECT catalog_id FROM {catalogs} c WHERE is_public")
def visible_catalogs_anonymous(spark, sf):
    return Z.visible_catalogs(standin(spark, sf, "catalogs"), _grants(spark, sf), None).select("catalog_id")


# Search

WORDS = r"' ' || regexp_replace(lower({c}), '[^\p{L}\p{N}]+', ' ', 'g') || ' '"


def _duck_match(column: str, query: str) -> str:
    """The search expressions of this module in SQL, spelled out; ``{x}`` stands for a word or phrase that occurs."""
    form = {
        'the and or der die -"of the"': "(({the} AND {and}) OR ({der} AND {die})) AND NOT {of the}", "the and or der die -of": "(({the} AND {and}) OR ({der} AND {die})) AND NOT {of}",
        "red": "{red}", "asia or europe": "{asia} OR {europe}", "white or economy": "{white} OR {economy}",
    }[query]
    words = "(" + WORDS.replace("{c}", column) + ")"
    return "(" + re.sub(r"\{([a-z ]+)\}", lambda m: f"contains({words}, ' {m[1]} ')", form) + ")"


TEXT_QUERY = 'the and or der die -"of the"'


def _index(spark, sf):
    """The index kept beside ``documents``: made when it is first asked for in a session, then read."""
    kept = (spark.sparkContext.applicationId, sf)
    if kept not in _INDEXES:
        _INDEXES[kept] = f"{shared_dir(spark)}/sparcel-index-{uuid.uuid4().hex[:12]}"
        Q.write_index(Q.text_index(dealt(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text"), _INDEXES[kept])
    return spark.read.schema("token string, doc_id bigint").parquet(_INDEXES[kept])


_INDEXES: dict[tuple[str, str], str] = {}


@register("search_documents", f"SELECT doc_id, source FROM documents WHERE {_duck_match('text', TEXT_QUERY)}")
def search_documents(spark, sf):
    return Q.search_texts(table(spark, sf, "documents"), _index(spark, sf), "doc_id", "text", TEXT_QUERY).select("doc_id", "source")


PACKAGE_HIT = f"""({_duck_match('readme', 'red')} OR {_duck_match('display_name', 'red')} OR {_duck_match('description', 'red')}
      OR contains(slug, 'red') OR contains(display_name, 'red') OR contains(lower(catalog_slug || '/' || slug), 'red'))"""


#: Text fields of what is searched by stems, and its key.
FIELDS = {"packages": ("package_id", ("readme", "display_name", "description")), "catalogs": ("catalog_id", ("display_name", "description")), "collections": ("collection_id", ("name", "description"))}


def _segments(spark, sf, name):
    """The stem index kept beside a registry table: made when it is first asked for in a session, then read."""
    key, fields = FIELDS[name]
    kept = (spark.sparkContext.applicationId, f"{sf}/{name}")
    if kept not in _INDEXES:
        _INDEXES[kept] = f"{shared_dir(spark)}/sparcel-index-{uuid.uuid4().hex[:12]}"
        SegmentIndex(spark, _INDEXES[kept], key, fields).refresh(dealt(standin(spark, sf, name)))
    return SegmentIndex(spark, _INDEXES[kept], key, fields)


def _prefixes(spark, sf, name):
    """The prefix table of a registry table, kept in the same way."""
    kept = (spark.sparkContext.applicationId, f"{sf}/{name}/prefixes")
    if kept not in _INDEXES:
        _INDEXES[kept] = f"{shared_dir(spark)}/sparcel-prefixes-{uuid.uuid4().hex[:12]}"
        keys = {"packages": Q.package_keys, "catalogs": Q.catalog_keys, "users": Q.user_keys}[name](standin(spark, sf, name))
        write_prefixes(keys, _INDEXES[kept])
    return spark.read.parquet(_INDEXES[kept])


@register("search_packages", f"SELECT package_id, slug FROM {{packages}} p WHERE {PACKAGE_HIT} AND package_id IN ({VISIBLE}) ORDER BY package_id LIMIT 100 OFFSET 5")
def search_packages(spark, sf):
    found = Q.search_packages(standin(spark, sf, "packages"), _segments(spark, sf, "packages"), "red", _grants(spark, sf), 7).select("package_id", "slug")
    return G.paged(found, [F.col("package_id")], 100, 5)


@register("search_packages_anonymous", f"SELECT package_id, slug FROM {{packages}} p WHERE {PACKAGE_HIT} AND is_public")
def search_packages_anonymous(spark, sf):
    return Q.search_packages(standin(spark, sf, "packages"), _segments(spark, sf, "packages"), "red", _grants(spark, sf), None).select("package_id", "slug")


@register(
    "search_packages_stems",
    f"""SELECT package_id, slug FROM {{packages}} p WHERE (regexp_matches(lower(display_name), '(^| )red plates?( |$)') OR regexp_matches(lower(display_name), '(^| )(large|larger|larges) rings?( |$)')
      OR regexp_matches(lower(display_name), '(^| )gears?( |$)') AND NOT regexp_matches(lower(display_name), '(^| )blues?( |$)')) AND NOT regexp_matches(lower(display_name), '(^| )blues?( |$)')
      AND package_id IN ({VISIBLE})""",
)
def search_packages_stems(spark, sf):
    """A phrase, words in other forms, stop words and an exclusion, all by stems and inside one field."""
    query = '"red plates" or "the large rings" or gear -blue'
    return Q.search_packages(standin(spark, sf, "packages"), _segments(spark, sf, "packages"), query, _grants(spark, sf), 7).select("package_id", "slug")


CATALOG_HIT = f"({_duck_match('display_name', 'asia or europe')} OR {_duck_match('description', 'asia or europe')} OR starts_with(slug, 'asia or europe'))"


@register("search_catalogs", f"SELECT catalog_id, slug FROM {{catalogs}} c WHERE {CATALOG_HIT} AND catalog_id IN ({VISIBLE_CATALOGS})")
def search_catalogs(spark, sf):
    return Q.search_catalogs(standin(spark, sf, "catalogs"), _segments(spark, sf, "catalogs"), "asia or europe", _grants(spark, sf), 7).select("catalog_id", "slug")


COLLECTION_HIT = f"({_duck_match('name', 'white or economy')} OR {_duck_match('description', 'white or economy')})"


@register("search_collections", f"SELECT collection_id, name FROM {{collections}} c WHERE {COLLECTION_HIT} AND collection_id IN (SELECT collection_id FROM ({VISIBLE_COLLECTIONS}) v)")
def search_collections(spark, sf):
    return Q.search_collections(standin(spark, sf, "collections"), _segments(spark, sf, "collections"), "white or economy", _grants(spark, sf), 7).select("collection_id", "name")


@register(
    "search_all_registries",
    f"""SELECT registry, doc_id, hit_no FROM (SELECT source AS registry, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS hit_no FROM documents WHERE {_duck_match('text', TEXT_QUERY)}) WHERE hit_no <= 20""",
)
def search_all_registries(spark, sf):
    registries = table(spark, sf, "documents").withColumnRenamed("source", "registry")
    return Q.search_all_registries(registries, _index(spark, sf), TEXT_QUERY, "text", "doc_id").select("registry", "doc_id", "hit_no")


USER_HIT = "(starts_with(username, 'customer-00000001') OR starts_with(email, 'customer-00000001') OR starts_with(first_name, 'customer-00000001') OR starts_with(last_name, 'customer-00000001'))"


@register("search_users", f"SELECT user_id, username FROM {{users}} u WHERE name_is_public AND {USER_HIT} ORDER BY user_id LIMIT 20")
def search_users(spark, sf):
    return Q.search_users(standin(spark, sf, "users"), "customer-00000001", 20).select("user_id", "username")


@register("search_users_unrestricted", f"SELECT user_id, username FROM {{users}} u WHERE {USER_HIT.replace('customer-00000001', 'MACH')} ORDER BY user_id LIMIT 50 OFFSET 10")
def search_users_unrestricted(spark, sf):
    return Q.search_users(standin(spark, sf, "users"), "MACH", 50, 10, restricted=False).select("user_id", "username")


TOKENS = r"SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS token FROM documents"


@register("text_index_refresh", f"SELECT token, count(*) AS documents, CAST(sum(doc_id) AS BIGINT) AS ids, TRUE AS in_proportion FROM ({TOKENS}) GROUP BY 1")
def text_index_refresh(spark, sf):
    """An index made before some texts changed, brought up to date in two refreshes; each writes what changed and no more."""
    documents = dealt(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    index = SegmentIndex(spark, scratch(spark, "segments"), "doc_id", ["text"], stemmed=False)
    late = F.col("doc_id") % 10 == 0
    stale = F.when(late, F.lit("before the first change")).when(F.col("lang") == "en", F.upper("source")).otherwise(F.col("text"))
    index.refresh(documents.withColumn("text", stale))
    index.refresh(documents.filter(F.col("lang") == "en"))
    written_late = index.refresh(documents.filter(late))
    small = F.lit(written_late < sum(rows for _, _, rows in index.segments()) / 3)
    return index.entries().groupBy("token").agg(F.count("*").alias("documents"), F.sum("doc_id").alias("ids")).withColumn("in_proportion", small)


@register(
    "search_index",
    f"""SELECT doc_id FROM documents WHERE {_duck_match('text', 'the and or der die -of')}""",
)
def search_index(spark, sf):
    return Q.search_index(_index(spark, sf), "doc_id", "the and or der die -of").filter("sure").select("doc_id")


@register(
    "autocomplete_packages",
    f"""SELECT package_id FROM {{packages}} p WHERE (starts_with(lower(slug), 'red b') OR (contains(lower(display_name), 'red') AND contains(lower(display_name), 'b')) OR starts_with(lower(catalog_slug || '/' || slug), 'red b'))
      AND package_id IN ({VISIBLE})""",
)
def autocomplete_packages(spark, sf):
    return Q.autocomplete_packages(standin(spark, sf, "packages"), _prefixes(spark, sf, "packages"), " Red b ", _grants(spark, sf), 7).select("package_id")


@register("autocomplete_catalogs", f"SELECT catalog_id FROM {{catalogs}} c WHERE (starts_with(slug, 'nation_1') OR starts_with(lower(display_name), 'nation_1')) AND catalog_id IN ({VISIBLE_CATALOGS})")
def autocomplete_catalogs(spark, sf):
    return Q.autocomplete_catalogs(standin(spark, sf, "catalogs"), _prefixes(spark, sf, "catalogs"), "NATION_1", _grants(spark, sf), 7).select("catalog_id")


@register("autocomplete_catalogs_anonymous", "SELECT catalog_id FROM {catalogs} c WHERE (starts_with(slug, 'nation_1') OR starts_with(lower(display_name), 'nation_1')) AND is_public")
def autocomplete_catalogs_anonymous(spark, sf):
    return Q.autocomplete_catalogs(standin(spark, sf, "catalogs"), _prefixes(spark, sf, "catalogs"), "NATION_1", _grants(spark, sf), None).select("catalog_id")


@register(
    "autocomplete_users",
    """SELECT user_id FROM {users} u WHERE starts_with(lower(username), 'machinery1') OR (email_is_public AND starts_with(lower(email), 'machinery1'))
      OR (name_is_public AND (starts_with(lower(first_name), 'machinery1') OR starts_with(lower(last_name), 'machinery1')))""",
)
def autocomplete_users(spark, sf):
    return Q.autocomplete_users(standin(spark, sf, "users"), _prefixes(spark, sf, "users"), "Machinery1").select("user_id")


# Listings


@register("latest_packages", f"SELECT package_id, price FROM {{packages}} p WHERE package_id IN ({VISIBLE}) ORDER BY price DESC, package_id DESC LIMIT 25 OFFSET 5")
def latest_packages(spark, sf):
    visible = Z.visible_packages(standin(spark, sf, "packages"), _grants(spark, sf), 7)
    return G.latest(visible, "price", "package_id", 25, 5).select("package_id", "price")


@register("latest_packages_total", f"SELECT count(*) AS total FROM ({VISIBLE}) v")
def latest_packages_total(spark, sf):
    return G.with_total(Z.visible_packages(standin(spark, sf, "packages"), _grants(spark, sf), 7))


@register(
    "latest_collections",
    f"SELECT collection_id, updated_at FROM {{collections}} c WHERE collection_id IN (SELECT collection_id FROM ({VISIBLE_COLLECTIONS}) v) ORDER BY updated_at DESC, collection_id DESC LIMIT 20",
)
def latest_collections(spark, sf):
    visible = Z.visible_collections(standin(spark, sf, "collections"), _grants(spark, sf), 7)
    return G.latest_collections(visible, standin(spark, sf, "collection_packages"), 20).select("collection_id", "updated_at")


@register("owned_listing", "SELECT package_id, display_name FROM {packages} p WHERE creator_id = 7 ORDER BY price DESC, package_id LIMIT 20")
def owned_listing(spark, sf):
    rows = G.owned(standin(spark, sf, "packages"), 7, [F.col("price").desc(), F.col("package_id")], 20)
    return rows.select("package_id", "display_name")


@register(
    "owned_or_granted_listing",
    """SELECT package_id, display_name FROM {packages} p WHERE creator_id = 7 OR package_id IN (SELECT package_id FROM {user_package} u WHERE user_id = 7 AND list_contains(permissions, 'EDIT'))
    ORDER BY lower(display_name), package_id LIMIT 20""",
)
def owned_or_granted_listing(spark, sf):
    rows = G.owned_or_granted(
        standin(spark, sf, "packages"), "package_id", standin(spark, sf, "user_package"), 7, "EDIT", [F.lower("display_name"), F.col("package_id")], 20
    )
    return rows.select("package_id", "display_name")


@register("catalog_packages", f"SELECT package_id, slug FROM {{packages}} p WHERE catalog_id = 3 AND package_id IN ({VISIBLE})")
def catalog_packages(spark, sf):
    visible = Z.visible_packages(standin(spark, sf, "packages"), _grants(spark, sf), 7)
    return visible.filter("catalog_id = 3").select("package_id", "slug")


@register("collection_packages", f"SELECT package_id, slug FROM {{packages}} p WHERE package_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 5) AND package_id IN ({VISIBLE})")
def collection_packages(spark, sf):
    visible = Z.visible_packages(standin(spark, sf, "packages"), _grants(spark, sf), 7)
    bridge = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("package_id"), "l_suppkey")
    return G.members(visible, bridge, "package_id", "l_suppkey", 5).select("package_id", "slug")


@register("package_collections", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 11)")
def package_collections(spark, sf):
    bridge = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey")
    return G.members(table(spark, sf, "supplier"), bridge, "s_suppkey", "l_partkey", 11).select("s_suppkey", "s_name")


@register("stale_packages", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 2")
def stale_packages(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return G.stale(orders, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 2)


FOLLOWERS = "SELECT user_id, target_package_id, min(created_at) AS created_at FROM {follows} f WHERE target_package_id IS NOT NULL GROUP BY 1, 2"


@register("followers", f"SELECT user_id, username, created_at FROM ({FOLLOWERS}) f JOIN {{users}} u USING (user_id) WHERE target_package_id = 22 ORDER BY created_at, user_id LIMIT 10 OFFSET 1")
def followers(spark, sf):
    rows = A.followers(standin(spark, sf, "follows"), "target_package_id", 22, standin(spark, sf, "users"), 10, 1)
    return rows.select("user_id", "username", "created_at")


@register("follower_counts", "SELECT @K AS target, count(DISTINCT user_id) AS followers FROM events GROUP BY 1")
def follower_counts(spark, sf):
    follows = spark_sql(spark, sf, "SELECT user_id, @K AS target FROM {events}")
    return A.follower_counts(follows, "target")


@register("issue_counts", "SELECT package_id, count(*) FILTER (WHERE status = 'OPEN') AS open_issues, count(*) FILTER (WHERE status = 'CLOSED') AS closed_issues FROM {issues} i GROUP BY 1")
def issue_counts(spark, sf):
    return G.issue_counts(standin(spark, sf, "issues"))


@register("issue_listing", "SELECT issue_id, status, subject FROM {issues} i WHERE package_id = 7 AND status = 'OPEN' ORDER BY created_at DESC, issue_id DESC LIMIT 10")
def issue_listing(spark, sf):
    return G.issue_listing(standin(spark, sf, "issues"), 7, include_closed=False, limit=10).select("issue_id", "status", "subject")


@register("last_created_issue", "SELECT package_id, arg_max(issue_id, (created_at, issue_id)) AS issue_id FROM {issues} i GROUP BY 1")
def last_created_issue(spark, sf):
    return G.last_created_issue(standin(spark, sf, "issues")).select("package_id", "issue_id")


@register("latest_version", "SELECT package_id, major, minor, patch, note FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC, patch DESC) AS n FROM {versions} v) WHERE n = 1")
def latest_version(spark, sf):
    return G.latest_version(standin(spark, sf, "versions"))


@register("latest_version_in_major", "SELECT package_id, major, minor, patch FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC, patch DESC) AS n FROM {versions} v WHERE major = 2) WHERE n = 1")
def latest_version_in_major(spark, sf):
    return G.latest_version(standin(spark, sf, "versions"), major=2).drop("note")


@register("version_page", "SELECT major, minor, patch FROM {versions} v WHERE package_id = 7 ORDER BY major DESC, minor DESC, patch DESC LIMIT 5 OFFSET 1")
def version_page(spark, sf):
    return G.version_page(standin(spark, sf, "versions"), 7, 5, 1).select("major", "minor", "patch")


LOG = "SELECT id, event_type FROM {activity} a WHERE user_id = 7 AND event_type IN ('PACKAGE_VIEWED', 'PACKAGE_EDIT')"


@register("activity_filter", f"{LOG} ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 5")
def activity_filter(spark, sf):
    rows, _ = A.activity_filter(standin(spark, sf, "activity"), limit=10, offset=5, event_types=["PACKAGE_VIEWED", "PACKAGE_EDIT"], user_id=7)
    return rows.select("id", "event_type")


@register("activity_filter_total", f"SELECT count(*) AS count, count(*) - 15 > 0 AS has_more FROM ({LOG}) l")
def activity_filter_total(spark, sf):
    return A.activity_filter(standin(spark, sf, "activity"), limit=10, offset=5, event_types=["PACKAGE_VIEWED", "PACKAGE_EDIT"], user_id=7)[1]


@register("activity_enrich", "SELECT a.id, u.username AS user_name, p.slug AS target_package_name FROM {activity} a LEFT JOIN {users} u ON u.user_id = a.user_id LEFT JOIN {packages} p ON p.package_id = a.target_package_id")
def activity_enrich(spark, sf):
    named = A.activity_enrich(standin(spark, sf, "activity"), {
        "user_id": (standin(spark, sf, "users"), "user_id", "username"), "target_package_id": (standin(spark, sf, "packages"), "package_id", "slug"),
    })
    return named.select("id", "user_name", "target_package_name")


@register("usage_counters", "SELECT @K AS target, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS fetches FROM events GROUP BY 1")
def usage_counters(spark, sf):
    log = spark_sql(spark, sf, "SELECT event_type, @K AS target FROM {events}")
    return A.usage_counters(log, "target", {"views": "view", "fetches": "purchase"})


@register("sitemap_pages", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 50000 AS page FROM orders WHERE o_totalprice > 20000")
def sitemap_pages(spark, sf):
    items = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 20000).alias("is_public"))
    return G.sitemap_pages(items, "o_orderkey").select("o_orderkey", "page")


@register("numbered_by_id", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position FROM events")
def numbered_by_id(spark, sf):
    from sparcel.operators.numbering import numbered_by_id as number

    return number(table(spark, sf, "events").select("event_type", "event_id"), "event_id", by=["event_type"])


