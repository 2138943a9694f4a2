"""Listings of packages, versions, issues and members, page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparcel.functions.versions import version_struct
from sparcel.operators.numbering import numbered_by_id

SITEMAP_PAGE = 50_000


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; with a limit Spark keeps the top rows per task instead of sorting everything."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def with_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def latest(df: DataFrame, time: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    return paged(df, [F.col(time).desc(), F.col(key).desc()], limit, offset)


def latest_collections(collections: DataFrame, members: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Newest collections that hold a package."""
    filled = collections.join(members.select("collection_id").distinct(), "collection_id", "left_semi")
    return latest(filled, "updated_at", "collection_id", limit, offset)


def owned(df: DataFrame, creator: int, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return paged(df.filter(F.col("creator_id") == creator), order, limit, offset)


def owned_or_granted(
    df: DataFrame, key: str, grants: DataFrame, user: int, permission: str, order: list[Column], limit: int, offset: int = 0
) -> DataFrame:
    """Items a user made, or holds a permission for."""
    keys = (
        grants.filter((F.col("user_id") == user) & F.array_contains("permissions", permission))
        .select(F.col(key).alias("_key")).distinct()
    )
    marked = df.join(keys, F.col(key) == F.col("_key"), "left")
    kept = marked.filter((F.col("creator_id") == user) | F.col("_key").isNotNull()).drop("_key")
    return paged(kept, order, limit, offset)


def members(items: DataFrame, bridge: DataFrame, key: str, owner: str, owner_id: int) -> DataFrame:
    """Items that a bridge table puts under one owner."""
    keys = bridge.filter(F.col(owner) == owner_id).select(key).distinct()
    return items.join(keys, key, "left_semi")


def stale(df: DataFrame, time: str, before: Column, limit: int = 2) -> DataFrame:
    """Longest without an update before a cut-off, oldest first."""
    return paged(df.filter(F.col(time) < before), [F.col(time).asc(), F.col(df.columns[0]).asc()], limit)


def issue_counts(issues: DataFrame, target: str = "package_id") -> DataFrame:
    return issues.groupBy(target).agg(
        F.count_if(F.col("status") == "OPEN").alias("open_issues"),
        F.count_if(F.col("status") == "CLOSED").alias("closed_issues"),
    )


def issue_listing(
    issues: DataFrame, package: int, *, include_open: bool = True, include_closed: bool = True,
    order_by: str = "created_at", limit: int = 20, offset: int = 0,
) -> DataFrame:
    kept = issues.filter(F.col("package_id") == package)
    if include_open != include_closed:
        kept = kept.filter(F.col("status") == ("OPEN" if include_open else "CLOSED"))
    return paged(kept, [F.col(order_by).desc(), F.col("issue_id").desc()], limit, offset)


def last_created_issue(issues: DataFrame) -> DataFrame:
    rest = [c for c in issues.columns if c != "package_id"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "issue_id")).alias("i")
    return issues.groupBy("package_id").agg(newest).select("package_id", "i.*")


def _version(df: DataFrame) -> Column:
    return version_struct(F.col("major"), F.col("minor"), F.col("patch"))


def latest_version(versions: DataFrame, major: int | None = None) -> DataFrame:
    """Newest version per package, optionally within a major version."""
    if major is not None:
        versions = versions.filter(F.col("major") == major)
    rest = [c for c in versions.columns if c != "package_id"]
    newest = F.max_by(F.struct(*rest), _version(versions)).alias("v")
    return versions.groupBy("package_id").agg(newest).select("package_id", "v.*")


def version_page(versions: DataFrame, package: int, limit: int, offset: int = 0) -> DataFrame:
    kept = versions.filter(F.col("package_id") == package)
    return paged(kept, [F.col(c).desc() for c in ("major", "minor", "patch")], limit, offset)


def sitemap_pages(items: DataFrame, key: str, page_size: int = SITEMAP_PAGE) -> DataFrame:
    """Public items with the number of their site-map page, in order of their id."""
    public = items.filter("is_public")
    numbered = numbered_by_id(public, key, name="_position")
    return numbered.withColumn("page", F.floor(F.col("_position") / page_size)).drop("_position")
