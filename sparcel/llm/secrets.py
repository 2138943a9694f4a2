"""Secret scans with a ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table in a shared folder that says which
rules, in which version, a blob has been scanned with and what they found. A scan looks up the blobs of the given rows, scans
only the pairs of blob and rule version that the ledger does not have, appends them, and joins the findings of the current
rules back to every row. Only one holder of each unseen blob is scanned, whatever the number of its copies.

Positions come from cutting a text at a rule's matches: the lengths of the pieces and matches before one add up to its start.
They are code points, ends exclusive.

Defined results: a NULL text is an empty one; NULL paths and repeated rows keep their rows and get their blob's findings; a
text without a secret has no spans; spans of different kinds may overlap; an empty table adds nothing to the ledger; other
columns are never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sparcel.llm.common import document_text, free, fresh
from sparcel.session import scratch, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; a change needs a new ``version``."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds every scan has.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: What stands in the body of a key besides single hyphens.
BODY = r"[A-Za-z0-9+/=:,. \t\r\n]"
#: Further kinds. A private key goes to its END line, or where there is none over the lines of base64 that follow; its groups are
#: possessive, so a text of any length is matched without recursion.
MORE = (
    Rule("pem", 2, rf"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----(?:{BODY}*+(?:-{BODY}++)*+-----END [A-Z0-9 ]*?PRIVATE KEY-----|(?:[ \t\r\n]*+[A-Za-z0-9+/=]{{16,}}+)*+)", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("url", 2, r"://[^ \t\r\n\x0B\f/:@]+:[^ \t\r\n\x0B\f/@]{3,}@", 0, 1),
)
RULES = BASE + MORE

SPAN = "struct<start: int, end: int>"
SCANNED = f"array<struct<kind: string, version: int, spans: array<{SPAN}>>>"
LEDGER = f"blob binary, scanned {SCANNED}"
#: Matches whose positions are added up in one array; arrays of them are joined afterwards, so no array is copied match by match.
BLOCK = 256


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, rule: Rule) -> Column:
    """The spans of a rule's leftmost non-overlapping matches in the column ``text``."""
    pattern = _literal(rule.pattern)
    return F.expr(f"""
        CASE WHEN NOT {text} RLIKE {pattern} THEN cast(array() AS array<{SPAN}>) ELSE
          transform(array(arrays_zip(
              slice(split({text}, {pattern}, -1), 1, size(regexp_extract_all({text}, {pattern}, 0))),
              regexp_extract_all({text}, {pattern}, 0),
              regexp_extract_all({text}, {pattern}, {rule.group}))), m ->
            transform(filter(flatten(aggregate(
              transform(sequence(0, cast((size(m) - 1) DIV {BLOCK} AS int)), b -> slice(m, b * {BLOCK} + 1, {BLOCK})),
              struct(0 AS at, cast(array() AS array<array<struct<start: int, end: int, size: int>>>) AS done),
              (held, part) -> transform(array(aggregate(
                  part,
                  struct(held.at AS at, cast(array() AS array<struct<start: int, end: int, size: int>>) AS done),
                  (a, x) -> struct(
                    a.at + length(x['0']) + length(x['1']) AS at,
                    concat(a.done, array(struct(a.at + length(x['0']) AS start, a.at + length(x['0']) + length(x['1']) AS end, length(x['2']) AS size))) AS done)
                )), r -> struct(r.at AS at, concat(held.done, array(r.done)) AS done))[0],
              held -> held.done)), s -> s.size >= {rule.least}), s -> struct(s.start AS start, s.end AS end)))[0] END""")


def _blob(text: str) -> Column:
    return F.unhex(F.sha2(document_text(text).cast("binary"), 256))


def read_ledger(spark, ledger: str) -> DataFrame:
    """The ledger in a folder; none there yet is an empty one."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def scan_blobs(versions: DataFrame, ledger: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the pairs of blob and rule version that ``ledger`` does not have, and append them to it."""
    spark = versions.sparkSession
    rows = versions.select(F.col(path).alias("path"), document_text(text).alias("text")).withColumn("blob", _blob("text"))
    holders = rows.groupBy("blob").agg(F.min("path").alias("holder"))
    seen = read_ledger(spark, ledger).select("blob", F.explode("scanned").alias("s"))
    seen = seen.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "s.kind", "s.version")).alias("seen"))
    wanted = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    todo = holders.join(seen, "blob", "left").select("blob", "holder", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = todo.where(F.size("todo") > 0).withColumnRenamed("blob", "unseen")
    # by blob and path: the copies of a blob are not gathered in one task
    texts = rows.join(todo, (F.col("blob") == F.col("unseen")) & F.col("path").eqNullSafe(F.col("holder")))
    found = [
        F.when(F.array_contains("todo", f"{r.kind}@{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of("text", r).alias("spans")))
        for r in rules
    ]
    new = texts.select("blob", F.filter(F.array(*found), lambda x: x.isNotNull()).cast(SCANNED).alias("scanned"))
    new.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)


def _findings(spark, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, spans)`` of the blobs with findings of the current rules; spans by start, then in the rules' order."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}@{r.version}", i)])
    rows = read_ledger(spark, ledger).select("blob", F.explode(F.filter("scanned", lambda s: F.size(s["spans"]) > 0)).alias("s"))
    rows = rows.select("blob", "s.*", order[F.concat_ws("@", "s.kind", "s.version")].alias("rank")).where("rank IS NOT NULL")
    spans = rows.dropDuplicates(["blob", "kind"]).select(
        "blob", F.transform("spans", lambda p: F.struct(p["start"].alias("start"), F.col("rank").alias("rank"), F.col("kind").alias("kind"), p["end"].alias("end"))).alias("spans")
    )
    return spans.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan_secrets(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", name: str = "secrets", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with an array ``name`` of ``start``, ``rank``, ``kind``, ``end`` of the secrets in each row's text.

    ``ledger`` is a folder all executors reach and is kept between scans; without one a new ledger is made for this scan. A table
    that has a column ``name`` already is an error.
    """
    free(versions, name)
    spark = versions.sparkSession
    ledger = ledger or scratch(spark, "ledger")
    scan_blobs(versions, ledger, path, text, rules)
    found = written(_findings(spark, ledger, rules), "findings")
    key = fresh(versions, "blob")
    found = found.withColumnRenamed("blob", key).withColumnRenamed("spans", name)
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>")
    return versions.withColumn(key, _blob(text)).join(found, key, "left").withColumn(name, F.coalesce(name, none)).drop(key)


def joined(spans: str, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of some kinds), comma-joined."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_secrets(documents: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret in ``text`` replaced by ``mark``, one mark for spans that overlap; ``n_chars`` follows."""
    name = fresh(documents, "secrets")
    found = scan_secrets(documents, ledger, path, text, name)
    clean = F.expr(f"""
        aggregate(
          transform(sequence(0, cast((size({name}) - 1) DIV {BLOCK} AS int)), b -> slice({name}, b * {BLOCK} + 1, {BLOCK})),
          struct(0 AS at, cast(array() AS array<string>) AS done),
          (held, part) -> transform(array(aggregate(part, struct(held.at AS at, cast(array() AS array<string>) AS done),
            (a, s) -> CASE WHEN s.end <= a.at THEN a WHEN s.start < a.at THEN struct(s.end AS at, a.done AS done)
              ELSE struct(s.end AS at, concat(a.done, array(substring(`{text}`, a.at + 1, s.start - a.at), {_literal(mark)})) AS done) END)),
            r -> struct(r.at AS at, concat(held.done, array(array_join(r.done, ''))) AS done))[0],
          a -> concat(array_join(a.done, ''), substring(`{text}`, a.at + 1)))""")
    touched = F.size(name) > 0
    columns = []
    for c in documents.columns:
        if c == text:
            columns.append(F.when(touched, clean).otherwise(F.col(c)).alias(c))
        elif c == "n_chars":
            columns.append(F.when(touched, F.length(clean).cast("bigint")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return found.select(*columns)
