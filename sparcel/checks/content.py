"""Sensitive-content labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparcel.checks.base import dealt, register, spark_sql, table
from sparcel.operators import labels as L
from sparcel.operators import sampling as SA

# RE2 forms of the value patterns. Word boundaries are ASCII in RE2.
DUCK = {
    "credit_card_number": r"\b(?:4\d{15}|4\d{12}|[25][1-7]\d{14}|6(?:011|5\d\d)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|(?:2131|1800|35\d{3})\d{11})\b",
    "ip_v4_address": r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)",
    "phone_number": r"\b(?:\+?\d{1,3}[-. (]+)?\d{3}[-. )]+\d{3}[-. ]+\d{4}(?: *x\d+)?\b",
    "email_address": r"\S@\S+\.\S",
    "ip_v6_address": L.IPV6,
    "social_security_number": r"\b\d{3}-?\d{2}-?\d{4}\b",
}
TEXTS = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}


def _duck_hits(label: str, column: str = "x") -> str:
    hit = f"regexp_matches({column}, '{DUCK[label]}')"
    if label != "social_security_number":
        return hit
    numbers = f"regexp_extract_all({column}, '{DUCK[label]}')"
    plain = "replace(v, '-', '')"
    good = f"substr({plain}, 1, 3) NOT IN ('000', '666') AND substr({plain}, 1, 1) <> '9' AND substr({plain}, 4, 2) <> '00' AND substr({plain}, 6, 4) <> '0000'"
    return f"len(list_filter({numbers}, lambda v: {good})) > 0"


ALL_TEXTS = " UNION ALL ".join(f"SELECT '{t}' AS source, {c} AS x FROM {t}" for t, c in TEXTS.items())


def _register_detector(key: str, label: str) -> None:
    oracle = f"SELECT source, count(*) FILTER (WHERE {_duck_hits(label)}) AS hits, count(x) AS tested FROM ({ALL_TEXTS}) GROUP BY 1"

    @register(key, oracle)
    def query(spark, sf):
        out = None
        for source, column in TEXTS.items():
            counts = table(spark, sf, source).agg(
                F.count_if(L.detect(F.col(column), label)).alias("hits"), F.count(column).alias("tested")
            ).withColumn("source", F.lit(source))
            out = counts if out is None else out.unionByName(counts)
        return out


for _key, _label in (
    ("detect_ssn", "social_security_number"), ("detect_credit_card", "credit_card_number"), ("detect_ipv6", "ip_v6_address"),
    ("detect_ipv4", "ip_v4_address"), ("detect_phone", "phone_number"), ("detect_email", "email_address"),
):
    _register_detector(_key, _label)

# Numbers and addresses made from given rows, with and without hits; what is expected is worked out from the keys, not by a pattern.
_MADE = "SELECT *, c_custkey * 7 % 1000 AS area, c_custkey % 100 AS part, c_custkey * 13 % 10000 AS serial FROM {customer}"
_MADE_SSN = f"""SELECT 'no ' || lpad(cast(area AS @TEXT), 3, '0') || '-' || lpad(cast(part AS @TEXT), 2, '0') || '-' || lpad(cast(serial AS @TEXT), 4, '0') || '.' AS often,
    CASE WHEN c_custkey % 4 = 0 THEN 'no ' || lpad(cast(area AS @TEXT), 3, '0') || lpad(cast(part AS @TEXT), 2, '0') || lpad(cast(serial AS @TEXT), 4, '0') ELSE c_name END AS seldom,
    100000000 + area * 1000000 + part * 10000 + serial AS number, area, part, serial, c_custkey FROM ({_MADE}) m"""
_VALID = "part <> 0 AND serial <> 0 AND {a} NOT IN (0, 666) AND {a} < 900"


def _made_counts(column: str, kind: str, hit: str) -> str:
    return f"SELECT '{column}' AS property, '{kind}' AS type, count(*) FILTER (WHERE {hit}) AS occurrence_count, count(*) AS tested_count, count(*) FILTER (WHERE {hit}) / count(*) > 0.66 AS applied FROM {{made}}"


@register(
    "detect_ssn_made",
    f"""WITH made AS ({_MADE_SSN}) """ + " UNION ALL ".join((
        _made_counts("often", "string", _VALID.replace("{a}", "area")),
        _made_counts("seldom", "string", "c_custkey % 4 = 0 AND " + _VALID.replace("{a}", "area")),
        _made_counts("number", "integer", "area < 900 AND " + _VALID.replace("{a}", "(area + 100)")),
    )).replace("{made}", "made"),
)
def detect_ssn_made(spark, sf):
    rows = L.scan_content_labels(spark_sql(spark, sf, _MADE_SSN), columns=["often", "seldom", "number"], labels=["social_security_number"])
    return rows.drop("label")


_MADE_IPV6 = """SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'host 2001:db8:' || lower(hex(c_custkey % 65536)) || ':0:0:0:0:1 up' ELSE 'at 12:30 and 5:6:7' END AS many,
    CASE c_custkey % 5 WHEN 0 THEN 'fe80::' || lower(hex(c_custkey % 65536)) WHEN 1 THEN '::ffff:10.0.0.7' ELSE c_name END AS few FROM {customer}"""


@register(
    "detect_ipv6_made",
    """SELECT 'many' AS property, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS occurrence_count, count(*) AS tested_count, count(*) FILTER (WHERE c_custkey % 3 <> 0) / count(*) > 0.66 AS applied FROM customer
    UNION ALL SELECT 'few', count(*) FILTER (WHERE c_custkey % 5 < 2), count(*), FALSE FROM customer""",
)
def detect_ipv6_made(spark, sf):
    rows = L.scan_content_labels(spark_sql(spark, sf, _MADE_IPV6), labels=["ip_v6_address"])
    return rows.drop("label", "type")


# Columns under names that say what they hold: name -> (table, column, SQL of the value).
NAMED = {
    "detect_gender": ("gender", "Gender", "customer", "c_mktsegment"),
    "detect_birthdate": ("birthdate", "date_Of_birth", "orders", "CAST(o_orderdate AS DATE)"),
    "detect_drivers_license": ("drivers_license", "driversLicense", "customer", "c_custkey"),
    "detect_age": ("age", "age", "part", "p_size"),
    "detect_username": ("username", "user_name", "customer", "c_name"),
    "detect_ethnicity": ("ethnicity", "race", "customer", "c_mktsegment"),
    "detect_secret": ("secret", "Password", "supplier", "s_name"),
    "detect_passport": ("passport", "Passport", "supplier", "s_suppkey"),
    "detect_npi": ("national_provider_id", "NationalProvider_Identifier", "supplier", "s_suppkey"),
    "detect_latitude": ("geo_latitude", "latitude_deg", "customer", "c_acctbal + 0.001"),
    "detect_longitude": ("geo_longitude", "longitude", "supplier", "s_acctbal + 0.001"),
}


def _register_name_detector(key: str, label: str, name: str, source: str, value: str) -> None:
    kind = {"birthdate": "date", "age": "integer", "drivers_license": "integer", "passport": "integer",
            "national_provider_id": "integer", "geo_latitude": "number", "geo_longitude": "number"}.get(label, "string")
    oracle = f"""SELECT '{name}' AS property, '{kind}' AS type, '{label}' AS label, CAST(1 AS BIGINT) AS occurrence_count, TRUE AS applied
      FROM {source} HAVING count({value}) > 0"""

    @register(key, oracle)
    def query(spark, sf):
        df = table(spark, sf, source).select(F.expr(f"{value} AS `{name}`"))
        return L.scan_content_labels(df, labels=[label]).select("property", "type", "label", "occurrence_count", "applied")


for _key, _spec in NAMED.items():
    _register_name_detector(_key, *_spec)


def _scan_sql(source: str, columns: list[str]) -> list[str]:
    return [
        f"SELECT '{source}' AS source, '{c}' AS property, 'string' AS type, '{label}' AS label, count(*) FILTER (WHERE {_duck_hits(label, c)}) AS occurrence_count, count({c}) AS tested_count FROM {source}"
        for c in columns for label in DUCK
    ]


SCANNED = {"documents": ["text", "lang", "source"], "pages": ["url", "html"], "conversations": ["role", "text"]}


@register(
    "scan_content_labels",
    "SELECT *, occurrence_count / tested_count > 0.66 AS applied FROM ("
    + " UNION ALL ".join(x for s, cs in SCANNED.items() for x in _scan_sql(s, cs)) + ") WHERE occurrence_count > 0",
)
def scan_content_labels(spark, sf):
    out = None
    for source, columns in SCANNED.items():
        rows = L.scan_content_labels(dealt(table(spark, sf, source)), columns=columns).withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "detect_person_name",
    r"""WITH names AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word FROM part UNION SELECT DISTINCT lower(split_part(text, ' ', 1)) FROM benchmark),
    vals AS (SELECT p_partkey AS k, 'p_name' AS property, p_name AS v FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part),
    toks AS (SELECT DISTINCT k, property, length(trim(v)) <= 40 AS short, unnest(list_filter(string_split_regex(lower(trim(v)), '[^\p{L}''-]+'), lambda w: w <> '')) AS word FROM vals),
    per AS (SELECT k, property, short, count(*) AS n, count(names.word) AS hits FROM toks LEFT JOIN names USING (word) GROUP BY 1, 2, 3)
    SELECT property, 'string' AS type, 'person_name' AS label, count(*) FILTER (WHERE hits > 0 AND (NOT short OR hits = n)) AS occurrence_count,
      count(*) AS tested_count, count(*) FILTER (WHERE hits > 0 AND (NOT short OR hits = n)) / count(*) > 0.66 AS applied FROM per GROUP BY 1""",
)
def detect_person_name(spark, sf):
    part = table(spark, sf, "part")
    first = F.lower(F.split_part("p_name", F.lit(" "), F.lit(1)))
    names = part.select(first.alias("name")).union(
        table(spark, sf, "benchmark").select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))))
    )
    return L.detect_person_names(part, ["p_name", "p_type"], names)


@register(
    "detect_person_name_in_text",
    r"""WITH names AS (SELECT DISTINCT lower(split_part(text, ' ', 1)) AS word FROM benchmark),
    toks AS (SELECT DISTINCT doc_id AS k, length(text) <= 40 AS short, unnest(list_filter(string_split_regex(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '[^\p{L}''-]+'), lambda w: w <> '')) AS word FROM documents),
    per AS (SELECT k, short, count(*) AS n, count(names.word) AS hits FROM toks LEFT JOIN names USING (word) GROUP BY 1, 2)
    SELECT 'text' AS property, count(*) FILTER (WHERE hits > 0 AND (NOT short OR hits = n)) AS occurrence_count, (SELECT count(*) FROM documents) AS tested_count FROM per""",
)
def detect_person_name_in_text(spark, sf):
    names = table(spark, sf, "benchmark").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("name"))
    rows = L.detect_person_names(dealt(table(spark, sf, "documents").select("text")), ["text"], names)
    return rows.select("property", "occurrence_count", "tested_count")


# The tests of a property: the first 101 values, then waits drawn from chances that fall with the tests so far.
SCHEDULE = """
    v AS (SELECT 'text' AS property, 'string' AS type, doc_id AS position, text AS value FROM documents UNION ALL SELECT 'lang', 'string', doc_id, lang FROM documents
      UNION ALL SELECT 'n_chars', 'integer', doc_id, CAST(n_chars AS VARCHAR) FROM documents),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY position, value) - 1 AS rank FROM v WHERE value IS NOT NULL),
    waits AS (SELECT property, type, t, CASE WHEN t < 101 THEN 1 ELSE 1 + CAST(floor(ln(1 - CAST('0x' || substr(md5('0-' || property || '-' || type || '-' || t), 1, 8) AS BIGINT) / 4294967296.0)
        / ln(1 - 1.0 / (t - 99))) AS BIGINT) END AS wait FROM (SELECT DISTINCT property, type FROM v), range(0, (SELECT 400 + 8 * CAST(sqrt(count(*)) AS BIGINT) FROM documents)) r(t)),
    due AS (SELECT property, t, sum(wait) OVER (PARTITION BY property ORDER BY t) - 1 AS rank FROM waits),
    sampled AS (SELECT ranked.*, due.t AS test FROM ranked JOIN due USING (property, rank))"""


@register("adaptive_sampling", f"WITH {SCHEDULE} SELECT property, type, position, test, rank FROM sampled")
def adaptive_sampling(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    return SA.sampled_values(documents, "doc_id").select("property", "type", "position", "test", "rank")


@register(
    "adaptive_labels",
    f"WITH {SCHEDULE} SELECT *, occurrence_count / tested_count > 0.66 AS applied FROM (" + " UNION ALL ".join(
        f"SELECT property, type, '{label}' AS label, count(*) FILTER (WHERE {_duck_hits(label, 'value')}) AS occurrence_count, count(*) AS tested_count FROM sampled WHERE type = 'string' GROUP BY ALL"
        for label in DUCK) + ") WHERE occurrence_count > 0",
)
def adaptive_labels(spark, sf):
    """Detectors run on the sampled values only."""
    return SA.sample_content_labels(table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"), "doc_id")


def _half_labels(spark, sf, lang_test):
    rows = L.scan_content_labels(table(spark, sf, "documents").filter(lang_test), columns=["text"])
    return rows.withColumn("hidden", F.col("label") == "email_address").drop("applied")


@register(
    "merge_labels",
    "SELECT *, label = 'email_address' AS hidden FROM (" + " UNION ALL ".join(
        f"""SELECT 'text' AS property, 'string' AS type, '{label}' AS label, count(*) FILTER (WHERE {_duck_hits(label, 'text')}) AS occurrence_count,
          CAST(coalesce(sum(n) FILTER (WHERE h), 0) AS BIGINT) AS tested_count
          FROM (SELECT text, 1 AS n, max({_duck_hits(label, 'text')}) OVER (PARTITION BY lang = 'en') AS h FROM documents)"""
        for label in DUCK) + ") WHERE occurrence_count > 0",
)
def merge_labels(spark, sf):
    return L.merge_labels(_half_labels(spark, sf, "lang = 'en'"), _half_labels(spark, sf, "lang <> 'en'"))


@register(
    "nested_labels",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT 'page.body.html' AS property, '{label}' AS label, count(*) FILTER (WHERE {_duck_hits(label, 'html')}) AS occurrence_count, count(html) AS tested_count FROM pages
        UNION ALL SELECT 'page.lines[]', '{label}', count(*) FILTER (WHERE {_duck_hits(label, 'line')}), count(line) FROM (SELECT unnest(string_split(html, '<p>')) AS line FROM pages)"""
        for label in DUCK) + ") WHERE occurrence_count > 0",
)
def nested_labels(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.struct(F.struct("html").alias("body"), F.split("html", "<p>").alias("lines")).alias("page")
    )
    return L.scan_content_labels(pages).select("property", "label", "occurrence_count", "tested_count")


