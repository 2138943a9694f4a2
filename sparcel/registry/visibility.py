"""Who may see what: public items, and items granted to a user or to one of their groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _groups_of(grants: Mapping[str, DataFrame], user: int) -> DataFrame:
    return grants["group_user"].filter(F.col("user_id") == user).select("group_id")


def granted(df: DataFrame, key: str, permission: str, column: str = "permissions") -> DataFrame:
    """Distinct keys of the grants that include a permission."""
    return df.filter(F.array_contains(column, permission)).select(F.col(key).alias("_granted")).distinct()


def visible_packages(packages: DataFrame, grants: Mapping[str, DataFrame], user: int | None, permission: str = "VIEW") -> DataFrame:
    """Packages ``(package_id, catalog_id, is_public …)`` that are public or granted to ``user``.

    ``grants``: user_catalog(user_id, catalog_id, permissions), user_package(user_id, package_id,
    permissions), group_package(group_id, package_id, permissions), group_catalog(group_id,
    catalog_id, permissions), group_user(group_id, user_id). The packages are scanned once; the
    keys granted to one user are joined to them.
    """
    if user is None:
        return packages.filter("is_public")
    groups = _groups_of(grants, user)
    own_catalogs = grants["user_catalog"].filter(F.col("user_id") == user)
    own_packages = grants["user_package"].filter(F.col("user_id") == user)
    catalogs = granted(own_catalogs, "catalog_id", permission).union(
        granted(grants["group_catalog"].join(groups, "group_id", "left_semi"), "catalog_id", permission)
    ).distinct()
    singles = granted(own_packages, "package_id", permission).union(
        granted(grants["group_package"].join(groups, "group_id", "left_semi"), "package_id", permission)
    ).distinct()
    marked = (
        packages.join(catalogs.withColumnRenamed("_granted", "_catalog"), F.col("catalog_id") == F.col("_catalog"), "left")
        .join(singles.withColumnRenamed("_granted", "_package"), F.col("package_id") == F.col("_package"), "left")
    )
    return marked.filter(
        F.col("is_public") | F.col("_catalog").isNotNull() | F.col("_package").isNotNull()
    ).drop("_catalog", "_package")


def visible_collections(collections: DataFrame, grants: Mapping[str, DataFrame], user: int | None, permission: str = "VIEW") -> DataFrame:
    """Collections that are public, or granted by user_collection or group_collection."""
    if user is None:
        return collections.filter("is_public")
    own = granted(grants["user_collection"].filter(F.col("user_id") == user), "collection_id", permission)
    by_group = granted(
        grants["group_collection"].join(_groups_of(grants, user), "group_id", "left_semi"), "collection_id", permission
    )
    keys = own.union(by_group).distinct()
    marked = collections.join(keys, F.col("collection_id") == F.col("_granted"), "left")
    return marked.filter(F.col("is_public") | F.col("_granted").isNotNull()).drop("_granted")


def visible_catalogs(catalogs: DataFrame, grants: Mapping[str, DataFrame], user: int | None, permission: str = "VIEW") -> DataFrame:
    """Catalogs ``(catalog_id, is_public …)`` that are public, or granted by user_catalog or group_catalog.

    Grants on a catalog itself (``catalog_permissions``) are apart from those on the packages in it.
    """
    if user is None:
        return catalogs.filter("is_public")
    own = granted(grants["user_catalog"].filter(F.col("user_id") == user), "catalog_id", permission, "catalog_permissions")
    groups = grants["group_catalog"].join(_groups_of(grants, user), "group_id", "left_semi")
    keys = own.union(granted(groups, "catalog_id", permission, "catalog_permissions")).distinct()
    marked = catalogs.join(keys, F.col("catalog_id") == F.col("_granted"), "left")
    return marked.filter(F.col("is_public") | F.col("_granted").isNotNull()).drop("_granted")
