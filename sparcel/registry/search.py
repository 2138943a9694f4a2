"""Text search, the token index behind it, and completion by prefix.

Packages, catalogs and collections are found by the stems of words, without stop words, through an index in segments
(``segments``); free texts by lower-case words as they are written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparcel.registry.prefixes import INSIDE, complete, prefix_keys
from sparcel.registry.stems import NOT_WORD, stems, stems_of
from sparcel.registry.visibility import visible_catalogs, visible_collections, visible_packages

if TYPE_CHECKING:
    from sparcel.registry.segments import SegmentIndex

HITS_PER_REGISTRY = 20


@dataclass(frozen=True)
class Query:
    """Alternatives of required phrases, and phrases that must not occur."""

    any_of: tuple[tuple[str, ...], ...]
    none_of: tuple[str, ...]

    def words(self) -> list[str]:
        return sorted({w for phrase in {t for g in self.any_of for t in g} | set(self.none_of) for w in phrase.split()})


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def web_query(text: str) -> Query:
    """Words must all occur; ``"a b"`` is a phrase, ``or`` separates alternatives, ``-x`` excludes."""
    groups: list[list[str]] = [[]]
    none: list[str] = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        term = " ".join(words_of(phrase or word))
        if term:
            (none if minus else groups[-1]).append(term)
    return Query(tuple(tuple(g) for g in groups if g), tuple(none))


def stemmed_query(spark: SparkSession, text: str) -> Query:
    """The query by stems; stop words ask for nothing."""
    parsed = web_query(text)
    terms = sorted({t for g in parsed.any_of for t in g} | set(parsed.none_of))
    stem = {t: " ".join(s) for t, s in zip(terms, stems_of(spark, terms))}
    groups = tuple(tuple(stem[t] for t in g if stem[t]) for g in parsed.any_of)
    return Query(tuple(g for g in groups if g), tuple(stem[t] for t in parsed.none_of if stem[t]))


def spaced_stems(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(stems(text), " "), F.lit(" "))


def spaced_words(text: Column) -> Column:
    """Lower-case words between single spaces, with a space at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), NOT_WORD, " "), F.lit(" "))


def matches(text: Column, query: Query, spaced: Callable[[Column], Column] = spaced_words) -> Column:
    """Does a text match? Evaluated in the scan, without any shuffle."""
    words = spaced(text)

    def has(term: str) -> Column:
        return words.contains(f" {term} ")

    hit = F.lit(False)
    for group in query.any_of:
        every = F.lit(True)
        for term in group:
            every = every & has(term)
        hit = hit | every
    if not query.any_of and query.none_of:
        hit = F.lit(True)
    for term in query.none_of:
        hit = hit & ~has(term)
    return F.coalesce(hit, F.lit(False))


def text_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key): the index to keep beside the texts, written partitioned or sorted by token.

    Repeated words of a text are dropped in its own row, without any shuffle; only a key of several rows can have a word twice, which
    lookups, grouping by key, do not mind.
    """
    words = df.select(F.col(key), F.explode(F.array_distinct(F.split(F.lower(F.col(text)), NOT_WORD))).alias("token"))
    return words.filter("token <> ''").select("token", key)


def write_index(index: DataFrame, path: str) -> None:
    """Keep an index: sorted by token over all its files, so the entries of a word lie together and the rest is skipped."""
    index.repartitionByRange("token", index.columns[-1]).sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def _word_hits(index: DataFrame, key: list[str], query: Query) -> tuple[DataFrame, dict[str, Column]]:
    """A row for each key with a word of the query, and which words it has. Only their entries are read, and grouped by key."""
    words = query.words()
    found = index.filter(F.col("token").isin(words)).groupBy(*key).agg(*[F.max(F.col("token") == w).alias(f"w{i}") for i, w in enumerate(words)])
    return found, {w: F.col(f"w{i}") for i, w in enumerate(words)}


def search_index(index: DataFrame, key: str | list[str], query: str | Query) -> DataFrame:
    """``(key, sure)``: keys whose words match a query; ``sure`` unless a phrase of several words has to be looked up in the text."""
    parsed, key = web_query(query) if isinstance(query, str) else query, [key] if isinstance(key, str) else key
    if not parsed.any_of:
        raise ValueError("an index only finds texts that have some word")
    found, at = _word_hits(index, key, parsed)

    def has(phrase: str) -> Column:
        every = F.lit(True)
        for word in phrase.split():
            every = every & at[word]
        return every

    hit, sure = F.lit(False), F.lit(False)
    for group in parsed.any_of:
        every = F.lit(True)
        for term in group:
            every = every & has(term)
        hit = hit | every
        sure = sure | (every & F.lit(all(" " not in t for t in group)))
    for term in parsed.none_of:
        hit, sure = (hit & ~has(term), sure) if " " not in term else (hit, sure & ~has(term))
    return found.filter(hit).select(*key, sure.alias("sure"))


def search_texts(df: DataFrame, index: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """Rows of ``df`` whose text matches: found in a kept index; phrases are checked in the texts that have all their words."""
    hits = search_index(index, key, query)
    return df.join(hits, key).filter(F.col("sure") | matches(F.col(text), web_query(query))).drop("sure")


def search(
    df: DataFrame, query: str, text: Iterable[str], *, substring: Iterable[str] = (), prefix: Iterable[str] = (),
) -> DataFrame:
    """Rows whose text columns match, or whose names contain or start with the query."""
    parsed = web_query(query)
    hit = F.lit(False)
    for column in text:
        hit = hit | matches(F.col(column), parsed)
    for column in substring:
        hit = hit | F.coalesce(F.col(column).contains(query), F.lit(False))
    for column in prefix:
        hit = hit | F.coalesce(F.col(column).startswith(query), F.lit(False))
    return df.filter(hit)


def search_fields(df: DataFrame, index: SegmentIndex, query: str, also: Column) -> DataFrame:
    """Rows of which one text field matches by stems, or for which ``also`` holds.

    The fields are looked up in the index; only phrases are checked in the texts, of the rows that have all their stems.
    """
    parsed = stemmed_query(df.sparkSession, query)
    if not parsed.any_of:
        # nothing to look up: exclusions are for the texts, and a query of stop words finds no text
        hit = F.lit(False)
        for field in index.fields if parsed.none_of else ():
            hit = hit | (F.col(field).isNotNull() & matches(F.col(field), parsed, spaced_stems))
        return df.filter(hit | F.coalesce(also, F.lit(False)))
    hits = search_index(index.lookup(parsed.words()), [index.key, "field"], parsed)
    hits = hits.groupBy(index.key).agg(F.max("sure").alias("_sure"), F.collect_set("field").alias("_fields"))
    found = F.col("_sure")
    if any(" " in t for g in parsed.any_of for t in g) or any(" " in t for t in parsed.none_of):
        for field in index.fields:
            found = found | (F.array_contains("_fields", field) & matches(F.col(field), parsed, spaced_stems))
    rows = df.join(hits, index.key, "left").filter(F.coalesce(found, F.lit(False)) | F.coalesce(also, F.lit(False)))
    return rows.drop("_sure", "_fields")


def search_packages(packages: DataFrame, index: SegmentIndex, query: str, grants: Mapping[str, DataFrame], user: int | None) -> DataFrame:
    """Readme, name and description by stems; slug, name and ``catalog/slug`` by substring; of what ``user`` may see."""
    full = F.lower(F.concat("catalog_slug", F.lit("/"), "slug"))
    also = F.lit(False)
    for name in (F.col("slug"), F.col("display_name"), full):
        also = also | F.coalesce(name.contains(query), F.lit(False))
    return visible_packages(search_fields(packages, index, query, also), grants, user)


def search_catalogs(catalogs: DataFrame, index: SegmentIndex, query: str, grants: Mapping[str, DataFrame], user: int | None) -> DataFrame:
    return visible_catalogs(search_fields(catalogs, index, query, F.col("slug").startswith(query)), grants, user)


def search_collections(collections: DataFrame, index: SegmentIndex, query: str, grants: Mapping[str, DataFrame], user: int | None) -> DataFrame:
    return visible_collections(search_fields(collections, index, query, F.lit(False)), grants, user)


def search_all_registries(registries: DataFrame, index: DataFrame, query: str, text: str, key: str, limit: int = HITS_PER_REGISTRY) -> DataFrame:
    """The same query over every ``registry``, its first hits each, through the kept index of all their texts.

    Tasks keep their own first hits before the shuffle, so a large registry is no burden.
    """
    hits = search_texts(registries, index, key, text, query)
    place = F.row_number().over(Window.partitionBy("registry").orderBy(key))
    return hits.withColumn("hit_no", place).filter(F.col("hit_no") <= limit)


def search_users(users: DataFrame, value: str, limit: int, offset: int = 0, restricted: bool = True) -> DataFrame:
    """Users by prefix of a name or address; only public names unless unrestricted. Ordered by id."""
    hit = F.lit(False)
    for column in ("username", "email", "first_name", "last_name"):
        hit = hit | F.coalesce(F.col(column).startswith(value), F.lit(False))
    kept = users.filter(hit & F.col("name_is_public")) if restricted else users.filter(hit)
    return kept.orderBy("user_id").offset(offset).limit(limit)


def package_keys(packages: DataFrame) -> DataFrame:
    """Prefix keys of packages: slug and ``catalog/slug`` by their beginning, the name by any part of it."""
    return prefix_keys(packages, "package_id", {"slug": "slug", "full": F.concat("catalog_slug", F.lit("/"), "slug")}, {"display_name": "display_name"})


def catalog_keys(catalogs: DataFrame) -> DataFrame:
    return prefix_keys(catalogs, "catalog_id", {"slug": "slug", "display_name": "display_name"})


def user_keys(users: DataFrame) -> DataFrame:
    """Prefix keys of users; address and names are found only where the user made them public."""
    public = {"email": F.col("email_is_public"), "first_name": F.col("name_is_public"), "last_name": F.col("name_is_public")}
    return prefix_keys(users, "user_id", {c: c for c in ("username", *public)}, public=public)


def _named(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.withColumnRenamed("id", key), key, "left_semi")


def autocomplete_packages(packages: DataFrame, keys: DataFrame, starts_with: str, grants: Mapping[str, DataFrame], user: int | None) -> DataFrame:
    """Slug prefix, or every word inside the name, or a prefix of ``catalog/slug``; of what ``user`` may see."""
    wanted = starts_with.strip().lower()
    inside = None
    for word in wanted.split():
        ids = complete(keys, word, INSIDE)
        inside = ids if inside is None else inside.join(ids, "id", "left_semi")
    found = complete(keys, wanted)
    found = found.unionByName(inside) if inside is not None else found
    return visible_packages(_named(packages, found, "package_id"), grants, user)


def autocomplete_catalogs(catalogs: DataFrame, keys: DataFrame, starts_with: str, grants: Mapping[str, DataFrame], user: int | None) -> DataFrame:
    return visible_catalogs(_named(catalogs, complete(keys, starts_with), "catalog_id"), grants, user)


def autocomplete_users(users: DataFrame, keys: DataFrame, starts_with: str) -> DataFrame:
    """Username, and address or names only where the user made them public."""
    return _named(users, complete(keys, starts_with), "user_id")
