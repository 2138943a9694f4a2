"""The registered queries of the operators and their DuckDB equivalents."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from sparcel.llm import archives, decontaminate, language_model, licenses, pieces, quality, quantised, runs, secrets, topk, toxicity, tries
from sparcel.llm.common import Query, fold, table
from sparcel.llm.simhash import simhash_groups

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark, sf):
    """Probability that a document is toxic, and its offending sentences."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(documents, table(spark, sf, "labels"))
    return toxicity.score_toxicity(documents, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.size("toxicity.offending").alias("n_offending"),
        F.array_join(F.transform("toxicity.offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("offending"),
    )


@query
def op2_sentencepiece(spark, sf):
    """Number and digest of the pieces of every document, and whether they decode to its text."""
    encoded = pieces.round_trip(table(spark, sf, "documents").select("doc_id", "text"))
    return encoded.select(
        "doc_id", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op3_licenses(spark, sf):
    """License texts and notices in every document."""
    found = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("licenses").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"),
        F.array_max("licenses.share").alias("largest_share"), F.array_min("licenses.window").alias("first_window"),
    )


@query
def op4_quality(spark, sf):
    """Probability that a document is of quality 1."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, table(spark, sf, "labels"))
    return quality.score_quality(documents, model, "score").select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op5_simhash(spark, sf):
    """Fingerprint and group of every document."""
    return simhash_groups(table(spark, sf, "documents"))


@query
def op6_decontaminate(spark, sf):
    """Benchmark items in every document."""
    found = decontaminate.find_contamination(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"),
    )


@query
def op7_warc(spark, sf):
    """Every page through ARC and WARC archives and back."""
    return archives.archive_pages(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op7_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
    r AS (SELECT page_id, payload_bytes, sha1(body) AS payload_digest, max(page_id) OVER (PARTITION BY body) AS best FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 1000 AND best <> page_id THEN best END AS refers_to FROM r"""

_QUANTISED = """SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query
def op8_topk(spark, sf):
    """The five highest inner products of every 50th vector with the others."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLES["op8_topk"] = f"""
    WITH rows AS ({_QUANTISED}),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query
def op9_lm(spark, sf):
    """Cross-entropy difference of every document between documents of quality 1 and all documents."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return language_model.cross_entropy_difference(documents, table(spark, sf, "labels")).select("doc_id", "lm.*")


@query
def op10_secrets(spark, sf):
    """Secrets of every document, through a ledger of its own."""
    found = secrets.scan_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secrets.BASE)
    counts = [F.size(F.expr(f"filter(secrets, s -> s.kind = '{k}')")).cast("bigint").alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.joined("secrets", base).cast("binary"), 256).alias("base_sha256"), secrets.joined("secrets").alias("spans")
    )


def _duck_spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT row, {rank} AS rank, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
        'a': CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
        'n': length(m[i]), 'size': length(v[i])}}), lambda s: s.size >= {least})) AS s
      FROM (SELECT row, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v FROM d WHERE regexp_matches(t, {p}))"""


# Fixed values, written out again: the forms of the kinds.
_FORMS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), (
        "pem", r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----(?:[A-Za-z0-9+/=:,. \t\r\n]*(?:-[A-Za-z0-9+/=:,. \t\r\n]+)*-----END [A-Z0-9 ]*?PRIVATE KEY-----|(?:[ \t\r\n]*[A-Za-z0-9+/=]{16,})*)", 0, 1,
    ),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1), ("url", r"://[^ \t\r\n\x0B\f/:@]+:[^ \t\r\n\x0B\f/@]{3,}@", 0, 1),
)
ORACLES["op10_secrets"] = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({" UNION ALL ".join(_duck_spans(i, *f) for i, f in enumerate(_FORMS))}),
    spans AS (SELECT row, rank, kind, s.a AS a, kind || ':' || s.a || ':' || (s.a + s.n) AS span FROM found)
    SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))},
      sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans
    FROM d LEFT JOIN spans USING (row) GROUP BY row, doc_id"""


def _crc32(value: str) -> str:
    """DuckDB SQL of CRC-32 of a decimal number's text, a bit at a time (reflected form of the fixed polynomial)."""
    bits = f"list_transform(range(0, 8 * length({value})), lambda i: (ascii({value}[i // 8 + 1]) >> (i % 8)) & 1)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"


def _periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, from a place on repeating a few, if the hash of the id says so."""
    h, n = 1 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


@query
def op11_runs(spark, sf):
    """Periodic runs of words; the tail of every tenth document (by the hash of its id) is made periodic first."""
    found = runs.find_runs(table(spark, sf, "documents").select("doc_id", "text"), prepare=_periodic_tail)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # larger exponent first: 1 / exponent as an exact fraction in whole numbers, by cross multiplication
    best = F.expr("""aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (x, r) -> CASE
        WHEN x IS NULL THEN r WHEN r.length * x.period > x.length * r.period THEN r WHEN r.length * x.period < x.length * r.period THEN x
        WHEN (r.start, r.period) < (x.start, x.period) THEN r ELSE x END)""")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLES["op11_runs"] = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
    s AS (SELECT *, len(words) AS n, h // 10 AS g FROM d),
    f AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM s),
    w AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN words[i + 1] ELSE words[a + (i - a) % p + 1] END) ELSE words END AS words FROM f),
    e AS (SELECT row, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM w),
    m AS (SELECT x.row, y.i - x.i AS p, x.i, x.i - row_number() OVER (PARTITION BY x.row, y.i - x.i ORDER BY x.i) AS island
      FROM e x JOIN e y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
    stretches AS (SELECT row, p, min(i) AS start, count(*) + p AS length FROM m GROUP BY row, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
    r AS (SELECT row, start, length, min(p) AS period FROM stretches GROUP BY row, start, length),
    best AS (SELECT row, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY row ORDER BY length / period DESC, start, period) = 1),
    gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r),
    lines AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM r GROUP BY row),
    rest AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS t FROM e ANTI JOIN gone USING (row, i) GROUP BY row)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
      sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(rest.t, '')) AS collapsed_sha256
    FROM w LEFT JOIN best USING (row) LEFT JOIN lines USING (row) LEFT JOIN rest USING (row)"""


@query
def op12_vectors(spark, sf):
    """Links, group and survivor of every vector at a cosine of 0.95."""
    return quantised.near_vectors(table(spark, sf, "embeddings"))


ORACLES["op12_vectors"] = """
    WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
    s AS (SELECT row, vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v
      WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
    e AS (SELECT a.row AS a, b.row AS b, b.vec_id FROM s a JOIN s b ON a.row <> b.row AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.95),
    reach AS (SELECT row AS a, row AS b FROM v UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    root AS (SELECT reach.a AS row, min(v.vec_id) AS component_id FROM reach JOIN v ON v.row = reach.b GROUP BY reach.a),
    n AS (SELECT a AS row, count(*) AS n_links FROM e GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN root USING (row) LEFT JOIN n USING (row)"""


@query
def op13_trie(spark, sf):
    """Every node of the prefix trie of the conversations, each rebuilt on the first turns of its family's first."""
    return tries.prefix_trie(*tries.grafted(tries.numbered_turns(table(spark, sf, "conversations"))))


ORACLES["op13_trie"] = f"""
    WITH t AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT c, list(x ORDER BY i) AS own, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM t GROUP BY c),
    r AS (SELECT l.c, list_concat(coalesce(b.own, [])[1:l.h], l.own[l.h + 1:]) AS turns FROM l LEFT JOIN l b ON b.c = l.c - l.c % 100),
    m AS (SELECT c, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
    p AS (SELECT c, depth, md5(CAST(turns[1:depth] AS VARCHAR)) || depth AS node, md5(CAST(turns[1:depth - 1] AS VARCHAR)) || (depth - 1) AS parent,
        CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS size, depth = len(turns) AS ends FROM m),
    n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
        coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids
      FROM (SELECT node, CASE WHEN depth > 0 THEN parent END AS parent, depth, c, size, ends FROM p) GROUP BY node),
    k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
    pairs AS (SELECT DISTINCT a.node AS top, b.node FROM p a JOIN p b ON a.c = b.c AND a.depth <= b.depth),
    sums AS (SELECT top AS node, sum(CASE WHEN k.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens
      FROM pairs JOIN n ON n.node = pairs.node LEFT JOIN k ON k.node = pairs.node GROUP BY top)
    SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves,
      CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
    FROM n JOIN sums USING (node) LEFT JOIN k ON k.node = n.node LEFT JOIN n up ON up.node = n.parent"""
