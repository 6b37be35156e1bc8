"""Named queries over the driver's tables, each with a DuckDB counterpart where SQL can express it.

The page operators need titles, dates, field lines and links, which `documents` has not: KB derives them from a
document's id by fixed rules, in both dialects, so that each query covers the whole table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake import schema
from trustlake.functions import text as T
from trustlake.functions.addresses import private_host
from trustlake.functions.similarity import compared_text, similarity_of
from trustlake.functions.web import HIDDEN, LINE_ENDS, LINE_STARTS, html_anchors, html_text, raw_hrefs
from trustlake.operators import findings as W
from trustlake.operators import history as H
from trustlake.operators import signals as S
from trustlake.plans import audit as A
from trustlake.plans import classify as C
from trustlake.plans.numbering import numbered
from trustlake.plans.tables import dealt, shuffled, written
from trustlake.sources import landed as L
from trustlake.sources import scopes

SCORED_ROWS = 4096  # pairs of texts a task, some seconds
AS_OF = datetime(2026, 1, 15, 12, tzinfo=UTC)
_AS_OF_SQL = "TIMESTAMP '2026-01-15 12:00:00'"

#: What stands before a text, by id modulo their number. {f}: the page's family, a quarter of its id.
HEADERS = (
    "Status: Current\nOwner: Team A\nLast reviewed: 2025-12-01\nReview cadence: Quarterly\nCanonical: true\n",
    "Status: Legacy\nOwner: Team B\nReplaced by: Guide {f} v4\n",
    "Status: Supported\nLast reviewed: 2024-01-31\nApplies to: Production use\nSee Guide {f} v2.\n",
    "See: Guide {f} v9, or refer to Missing Page.\nScope: version=v1; region=eu\n",
    "Owner: Desk C\nLast reviewed: 2026-02-30\nVersion: v2\nRefer to Guide {f} v1.\n",
    "Status: Draft\nVisit https://site.example.org/a/{f}, (http://localhost/x) or https://www.notion.so/p.\n",
    "",
    "Deprecated as of: 2025-01-01\nMaintained by: Team D\nVersion: v1\n",
    "This page is no longer maintained\n",
    "Status: Current\nSee Guide {f} v1.\nReview cadence: Weekly\nLast reviewed: 2025-11-30\n",
    "Environment: prod\nDRI: Person E\nSee Guide {f}.\nThe API v1.2 is described here; formerly v1.0 was used.\n",
)


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as pages (schema.DOCUMENT)."""
    n = F.col("doc_id")
    family = (n / 4).cast("long").cast("string")
    version = (n % 4 + 1).cast("string")
    title = F.concat(F.lit("Guide "), family, F.when(n % 12 == 7, F.concat(F.lit(" "), (F.lit(2020) + n % 4).cast("string"))).when(n % 12 == 10, F.lit("")).otherwise(F.concat(F.lit(" v"), version)), F.when(n % 13 == 5, " (old)").otherwise(""))
    header = F.replace(F.element_at(F.array(*map(F.lit, HEADERS)), (n % len(HEADERS) + 1).cast("int")), F.lit("{f}"), family)
    link = F.struct(
        F.concat(F.lit("https://kb.example.org/p/"), (n + 1).cast("string"), F.lit("/")).alias("url"), F.lit(None).cast("string").alias("target_id"), F.when(n % 6 == 4, F.concat(F.lit("Guide "), family, F.lit(" v4"))).alias("target_title"),
        F.when(n % 5 == 0, "replaced by the next page").when(n % 5 == 1, "migration from the old page").otherwise("next").alias("text"), F.lit(None).cast("string").alias("context"), F.lit("kb").alias("source"),
    )
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(
        n.alias("doc_ord"), n.cast("string").alias("id"), title.alias("title"), F.concat(header, F.coalesce("text", F.lit(""))).alias("content"), F.col("source").alias("source_type"), F.concat(F.lit("https://kb.example.org/p/"), n.cast("string")).alias("url"),
        F.when(n % 17 != 0, F.timestamp_add("DAY", (n % 700).cast("int"), F.lit(datetime(2024, 1, 1, tzinfo=UTC)))).alias("last_modified"), (n % 101 == 50).alias("archived"), F.lit("{}").alias("metadata"),
        F.array().cast("array<string>").alias("metadata_links"), F.when(n % 3 == 0, F.array(link)).otherwise(F.array().cast(f"array<{schema.LINK}>")).alias("links"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEADER_SQL = "CASE doc_id % {n} {cases} END".format(n=len(HEADERS), cases=" ".join("WHEN %d THEN %s" % (i, _quoted(h).replace("\n", "' || chr(10) || '")) for i, h in enumerate(HEADERS)))
KB_SQL = f"""kb AS (SELECT doc_id AS doc_ord, CAST(doc_id AS VARCHAR) AS id,
  'Guide ' || (doc_id // 4) || CASE WHEN doc_id % 12 = 7 THEN ' ' || (2020 + doc_id % 4) WHEN doc_id % 12 = 10 THEN '' ELSE ' v' || (doc_id % 4 + 1) END || CASE WHEN doc_id % 13 = 5 THEN ' (old)' ELSE '' END AS title,
  replace({_HEADER_SQL}, '{{f}}', CAST(doc_id // 4 AS VARCHAR)) || coalesce(text, '') AS content,
  source AS source_type, 'https://kb.example.org/p/' || doc_id AS url, CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 700 AS INTEGER)) END AS last_modified,
  doc_id % 101 = 50 AS archived,
  CASE WHEN doc_id % 3 = 0 THEN 'https://kb.example.org/p/' || (doc_id + 1) || '/' END AS link_url, CASE WHEN doc_id % 6 = 4 AND doc_id % 3 = 0 THEN 'Guide ' || (doc_id // 4) || ' v4' END AS link_title,
  CASE doc_id % 5 WHEN 0 THEN 'replaced by the next page' WHEN 1 THEN 'migration from the old page' ELSE 'next' END AS link_text FROM documents)"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.prepare(kb(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function as a query under its name, with SQL if there is some."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def _sql_field(names: str, value: str = r"\S.+?", end: str = r"(?:\n|$)", source: str = "content") -> str:
    pattern = rf"(?i)(?:^|\n)\s*(?:{names})\s*[:]\s*({value}){end}"
    return f"CASE WHEN regexp_matches({source}, {_quoted(pattern)}) THEN trim(regexp_extract({source}, {_quoted(pattern)}, 1)) END"


_STATUS_SQL = _sql_field("Status", ".+?")
_OWNER_SQL = _sql_field(r"Owner|Maintained\s+by|DRI")
_REVIEWED_SQL = f"TRY_CAST({_sql_field('Last' + chr(92) + 's+reviewed', chr(92) + 'd{4}-' + chr(92) + 'd{2}-' + chr(92) + 'd{2}', '')} AS DATE)"


def _sql_title(title: str) -> dict[str, str]:
    """Base, version and stale mark of a title column."""
    stale = r"(?i)\s*\(\s*(?:old|deprecated|archived|legacy|obsolete|copy|draft|backup)\s*\)\s*$"
    year, ver = r"\s+(?:19|20)\d{2}\s*$", r"(?i)\s+(?:v|version\s*)\d+(?:\.\d+)*\s*$"
    rest = f"trim(regexp_replace(trim({title}), '{stale}', ''))"
    before = f"trim(regexp_replace({rest}, '{year}', ''))"
    dated = rf"(regexp_matches({rest}, '{year}') AND (regexp_matches({before}, '\S\s+\S') OR regexp_matches({before}, '{ver}')))"
    return {
        "base": f"lower(trim(regexp_replace(CASE WHEN {dated} THEN {before} ELSE {rest} END, '{ver}', '')))",
        "version": f"CASE WHEN {dated} THEN trim(regexp_extract({rest}, '{year}')) ELSE nullif(trim(regexp_extract({rest}, '{ver}')), '') END",
        "stale": f"nullif(trim(regexp_extract(trim({title}), '{stale}')), '')",
    }


_TITLE_SQL = _sql_title("title")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


@query(f"WITH {KB_SQL} SELECT id, title, {_TITLE_SQL['base']} AS base, {_TITLE_SQL['version']} AS version, {_TITLE_SQL['stale']} AS stale FROM kb")
def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb(spark, sf_dir).select("id", "title", T.title_parts(F.col("title")).alias("p")).select("id", "title", "p.*")


_DAYS_SQL = f"CAST(floor((epoch_us({_AS_OF_SQL}) - epoch_us(last_modified)) / 86400000000) AS INTEGER)"


@query(f"""WITH {KB_SQL}, a AS (SELECT id, {_DAYS_SQL} AS age_days FROM kb)
SELECT id AS doc_id, age_days, CASE WHEN age_days >= 180 THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN age_days IS NULL THEN 'No last-modified date available' ELSE 'Document is ' || age_days || ' days old (threshold: ' || CASE WHEN age_days >= 180 THEN 180 ELSE 90 END || ')' END AS message
FROM a WHERE age_days IS NULL OR age_days >= 90""")
def doc_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.age(kb(spark, sf_dir), AS_OF).select("doc_id", F.col("details.age_days").alias("age_days"), "severity", "message")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the bare texts: exact copies stay copies."""
    return kb(spark, sf_dir).drop("content").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc_ord"), F.coalesce("text", F.lit("")).alias("content")), "doc_ord")


@query(f"""WITH {KB_SQL}, k AS (SELECT kb.*, sha256(coalesce(text, '')) AS h FROM kb JOIN documents ON doc_id = doc_ord),
w AS (SELECT *, row_number() OVER p AS rn, first_value(id) OVER p AS top, first_value(title) OVER p AS top_title FROM k WINDOW p AS (PARTITION BY h ORDER BY last_modified DESC NULLS LAST, doc_ord))
SELECT id AS doc_id, top AS duplicate_of, top_title AS duplicate_title FROM w WHERE rn > 1""")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.duplicates(_raw(spark, sf_dir).withColumn("content_hash", T.content_hash(F.col("content"))))
    return found.select("doc_id", "details.duplicate_of", "details.duplicate_title")


@query(f"""WITH {KB_SQL} SELECT id, {_STATUS_SQL} AS status_text, {_OWNER_SQL} AS owner, {_REVIEWED_SQL} AS last_reviewed, {_sql_field(r'Replaced' + chr(92) + 's+by|Superseded' + chr(92) + 's+by')} AS replaced_by,
  {_sql_field('Deprecated' + chr(92) + 's+as' + chr(92) + 's+of')} AS deprecated_as_of, regexp_matches(content, '(?i)(?:^|\\n)\\s*Canonical\\s*[:]\\s*(true|yes)\\s*(?:\\n|$)') AS canonical,
  {_sql_field('Review' + chr(92) + 's+cadence')} AS review_cadence, {_sql_field('Applies' + chr(92) + 's+to')} AS applies_to FROM kb""")
def body_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kb(spark, sf_dir).select("id", T.field_lines(F.col("content")).alias("lines"))
    return rows.select("id", T.body_metadata(F.col("lines")).alias("pm")).select("id", "pm.*")


_SCOPE_SQL = _sql_field("Scope")


_DIMENSIONS = {k: k.replace("_", chr(92) + "s+") for k in T.SCOPE_FIELDS}
_SCOPE_COLUMNS = ",\n  ".join(f"coalesce({_sql_field(name)}, nullif(trim(regexp_extract(line, '(?i)(?:^|;) *{k}=([^;]*)', 1)), '')) AS {k}" for k, name in _DIMENSIONS.items())


@query(f"""WITH {KB_SQL}, s AS (SELECT id, content, {_SCOPE_SQL} AS line FROM kb)
SELECT id, {_SCOPE_COLUMNS} FROM s""")
def applicability_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kb(spark, sf_dir).select("id", T.field_lines(F.col("content")).alias("lines"))
    scope = rows.select("id", T.applicability(F.col("lines")).alias("s"))
    return scope.select("id", *[F.element_at("s", k).alias(k) for k in T.SCOPE_FIELDS])


_VERSION_SQL = "list_max(list_transform(list_concat(regexp_extract_all(title || ' ' || content[:500], '(?i)\\bv(\\d+(?:\\.\\d+)*)\\b', 1), regexp_extract_all(title || ' ' || content[:500], '(?i)\\bversion\\s+(\\d+(?:\\.\\d+)*)\\b', 1)), lambda v: list_transform(string_split(v, '.'), lambda n: CAST(n AS BIGINT))))"


@query(f"""WITH {KB_SQL}, v AS (SELECT doc_ord, id, title, {_TITLE_SQL['base']} AS base, {_VERSION_SQL} AS ver, sha256(content) AS h FROM kb),
top AS (SELECT base, arg_max(id, (ver, -doc_ord)) AS top_id, max(ver) AS top FROM v WHERE ver IS NOT NULL GROUP BY base)
SELECT id AS doc_id, 'v' || array_to_string(ver, '.') AS found_version, 'v' || array_to_string(top, '.') AS current_version, top_id AS current_doc_id FROM v JOIN top USING (base) WHERE ver < top AND id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sha256(content) ORDER BY last_modified DESC NULLS LAST, doc_ord) AS rn FROM kb) WHERE rn > 1)""")
def version_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _prepared(spark, sf_dir).select("id", "doc_ord", "title", "base", "version_key", "content_hash", "last_modified")
    docs = written(docs, "query-versions")
    return S.version_markers(docs, S.duplicates(docs)).select("doc_id", "details.found_version", "details.current_version", "details.current_doc_id")


_REFERENCES_SQL = "list_filter(list_transform(list_concat(regexp_extract_all(content, '(?i)(?:For (?:more )?(?:details|information),?\\s+)?see:?\\s+([^\\n.,;]+)', 1), regexp_extract_all(content, '(?i)refer\\s+to:?\\s+([^\\n.,;]+)', 1)), lambda r: trim(r)), lambda r: r <> '')"
_RESOLVED_SQL = f"""refs AS (SELECT id, generate_subscripts({_REFERENCES_SQL}, 1) - 1 AS k, unnest({_REFERENCES_SQL}) AS ref FROM kb),
d AS (SELECT doc_ord, id AS tid, title AS tt, lower(title) AS lt, {_TITLE_SQL['base']} AS tb FROM kb),
e AS (SELECT r.id, r.k, r.ref, list(tid ORDER BY doc_ord) FILTER (tid IS NOT NULL) AS ids FROM refs r LEFT JOIN d ON lt = lower(ref) AND tid <> r.id GROUP BY ALL),
b AS (SELECT r.id, r.k, list(tid ORDER BY doc_ord) FILTER (tid IS NOT NULL) AS ids FROM refs r LEFT JOIN d ON tb = {_sql_title('ref')['base']} AND tid <> r.id GROUP BY ALL),
resolved AS (SELECT e.id, e.k, e.ref, coalesce(e.ids, b.ids, []) AS ids, e.ids IS NULL AND b.ids IS NOT NULL AS by_base FROM e JOIN b USING (id, k))"""


@query(f"""WITH {KB_SQL}, {_RESOLVED_SQL}
SELECT id AS doc_id, k, CASE len(ids) WHEN 0 THEN 'unresolved_reference' WHEN 1 THEN 'resolved_reference' ELSE 'ambiguous_reference' END AS signal_type, ref AS referenced_title,
  CASE WHEN len(ids) = 1 THEN ids[1] END AS resolved_doc_id, CASE WHEN len(ids) = 1 AND by_base THEN 'base_title_variant' END AS match_type, CASE WHEN len(ids) > 1 THEN array_to_string(ids, ',') END AS matching FROM resolved""")
def references_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.references(_prepared(spark, sf_dir))
    return found.select("doc_id", F.element_at("sig_ord", 1).alias("k"), "signal_type", "details.referenced_title", "details.resolved_doc_id", "details.match_type", F.array_join("details.matching_doc_ids", ",").alias("matching"))


@query(f"""WITH {KB_SQL}, {_RESOLVED_SQL}, link AS (SELECT kb.id, t.id AS tid FROM kb JOIN kb t ON rtrim(kb.link_url, '/') = t.url WHERE kb.id <> t.id AND NOT regexp_matches(kb.link_text, '(?i)replaced|migration from')),
edge AS (SELECT id, ids[1] AS tid FROM resolved WHERE len(ids) = 1 UNION SELECT id, tid FROM link) SELECT tid AS doc_id, CAST(count(DISTINCT id) AS INTEGER) AS incoming FROM edge GROUP BY tid""")
def incoming_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _prepared(spark, sf_dir)
    return S.incoming_counts(S.references(docs).unionByName(S.internal_links(docs)))


@query(f"""WITH {KB_SQL}, l AS (SELECT kb.id, kb.link_url, kb.link_text, list(t.id ORDER BY t.doc_ord) FILTER (t.id IS NOT NULL AND t.id <> kb.id) AS ids FROM kb LEFT JOIN kb t ON rtrim(kb.link_url, '/') = t.url WHERE kb.link_url IS NOT NULL GROUP BY ALL)
SELECT id AS doc_id, CASE WHEN ids IS NULL THEN 'broken_internal_link' WHEN link_text LIKE 'replaced by%' THEN 'replacement_link' WHEN link_text LIKE 'migration from%' THEN 'backlink_from_successor' ELSE 'resolved_internal_link' END AS signal_type, link_url AS url, ids[1] AS target_id FROM l""")
def internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.internal_links(_prepared(spark, sf_dir)).select("doc_id", "signal_type", "details.url", "details.target_id")


@query(f"""WITH {KB_SQL}, u AS (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(content, 'https?://[^\\s<>"'')]+'), lambda x: rtrim(x, '.,;:!?)')))) AS url FROM kb)
SELECT id AS doc_id, url FROM u WHERE NOT regexp_matches(url, '^https?://(www\\.)?(notion\\.so|(app\\.)?notion\\.com)/') AND NOT regexp_matches(url, '^https?://([^/]*\\.)?localhost([:/]|$)')""")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extracted_urls(kb(spark, sf_dir)).select("doc_id", "url")


@query(f"""WITH {KB_SQL}, u AS (SELECT DISTINCT id, unnest(list_transform(regexp_extract_all(content, 'https?://site[^\\s<>"'')]+'), lambda x: rtrim(x, '.,;:!?)'))) AS url FROM kb)
SELECT id AS doc_id, url, 404 AS status_code FROM u WHERE CAST(regexp_extract(url, '(\\d+)$', 1) AS BIGINT) % 2 = 0""")
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kb(spark, sf_dir)
    return S.broken_links(docs, _probes(docs)).select("doc_id", "details.url", "details.status_code")


def _probes(docs: DataFrame) -> DataFrame:
    """Answers to all web addresses of the pages: those that end in an even number are gone."""
    even = F.regexp_extract("url", r"(\d+)$", 1).try_cast("long") % 2 == 0
    return S.extracted_urls(docs).select("url").distinct().select("url", F.when(even, 404).otherwise(200).alias("status_code"), F.lit(None).cast("string").alias("error"))


# Hosts by rules of a number: addresses around the ranges that are not public.
@query("""WITH h AS (SELECT doc_id, doc_id % 8 AS k, CASE doc_id % 8 WHEN 0 THEN [doc_id // 8 % 256, doc_id * 7 % 256, doc_id * 13 % 256, doc_id % 256] WHEN 1 THEN [172, doc_id // 8 % 40, 3, 4] WHEN 2 THEN [192, 0, doc_id // 8 % 4, doc_id // 8 % 16]
  WHEN 3 THEN [198, doc_id // 8 % 60, doc_id % 110, 9] WHEN 4 THEN [169, 250 + doc_id // 8 % 6, 1, 1] WHEN 5 THEN [203, 0, 110 + doc_id // 8 % 6, 1] ELSE [192, 165 + doc_id // 8 % 6, 0, 1] END AS o FROM documents),
t AS (SELECT *, o[1] AS a, o[2] AS b, o[3] AS c, o[4] AS d FROM h)
SELECT doc_id, CASE WHEN k = 6 THEN 'https://[' || (CASE WHEN doc_id % 16 = 6 THEN '2001:DB8' ELSE '2606:4700' END) || '::' || (doc_id % 10) || ']:8080/' ELSE 'http://user@' || array_to_string(o, '.') || '/a?b@c' END AS url,
  CASE WHEN k = 6 THEN doc_id % 16 = 6 ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2)
    OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) END AS private FROM t""")
def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the derived addresses are not public."""
    n = F.col("doc_id")
    step = F.floor(n / 8)
    octets = {
        0: (step % 256, n * 7 % 256, n * 13 % 256, n % 256), 1: (F.lit(172), step % 40, F.lit(3), F.lit(4)), 2: (F.lit(192), F.lit(0), step % 4, step % 16), 3: (F.lit(198), step % 60, n % 110, F.lit(9)),
        4: (F.lit(169), 250 + step % 6, F.lit(1), F.lit(1)), 5: (F.lit(203), F.lit(0), 110 + step % 6, F.lit(1)), 7: (F.lit(192), 165 + step % 6, F.lit(0), F.lit(1)),
    }
    hosts = F.coalesce(*[F.when(n % 8 == k, F.concat_ws(".", *[o.cast("string") for o in os])) for k, os in octets.items()])
    six = F.concat(F.lit("https://["), F.when(n % 16 == 6, "2001:DB8").otherwise("2606:4700"), F.lit("::"), (n % 10).cast("string"), F.lit("]:8080/"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(n % 8 == 6, six).otherwise(F.concat(F.lit("http://user@"), hosts, F.lit("/a?b@c"))).alias("url"))
    return rows.select("doc_id", "url", private_host("url").alias("private"))


_API_SQL = r"'v\d+\.\d+(?:\.\d+)?'"
_PAST_SQL = r"(?i)(?:migrat\w+\s+from|upgrad\w+\s+from|previously|formerly|deprecated|replaced\s+by|instead\s+of|no\s+longer|was\s+in|changed\s+from|prior\s+to|before)\s+"


@query(f"""WITH {KB_SQL}, m AS (SELECT id, content, regexp_extract_all(content, {_API_SQL}) AS m, regexp_split_to_array(content, {_API_SQL}) AS g FROM kb WHERE regexp_matches(content, {_API_SQL})),
each AS (SELECT id, content, m, g, unnest(range(1, len(m) + 1)) AS k FROM m),
place AS (SELECT id, content, m[k] AS v, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS p FROM each),
near AS (SELECT *, substr(lower(content), greatest(0, p - 100) + 1, p + length(v) + 50 - greatest(0, p - 100)) AS around,
  trim(substr(content, greatest(0, p - 60) + 1, p - greatest(0, p - 60)), ' ' || chr(9) || chr(10)) AS said FROM place)
SELECT id AS doc_id, 'References ' || chr(39) || 'API ' || v || chr(39) || ' but current version is ' || chr(39) || 'v2.0' || chr(39) AS message, v AS found_version FROM near
WHERE v <> 'v2.0' AND contains(around, 'api') AND NOT regexp_matches(said, '{_PAST_SQL}')""")
def version_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.version_refs(kb(spark, sf_dir), {"API": "v2.0"}).select("doc_id", "message", "details.found_version")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(raw_hrefs(F.col("html"))).alias("href"))


def _sql_tags(names: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(names)})"


# The pages are closed markup without comments in texts, so patterns can read them; entities are those that occur.
_PLAIN_SQL = "html"
for _pattern, _put in (
    (r"(?s)<!--.*?-->", ""), (rf"(?s)<{_sql_tags(HIDDEN)}\b[^>]*>.*?</{_sql_tags(HIDDEN)}>", ""),
    (rf"<{_sql_tags(LINE_STARTS)}(?:\s[^>]*)?>|</{_sql_tags(LINE_ENDS)}>", "\n"), (r"</td>", " | "), (r"<[^>]*>", ""),
):
    _PLAIN_SQL = f"regexp_replace({_PLAIN_SQL}, {_quoted(_pattern)}, {'chr(10)' if _put == chr(10) else _quoted(_put)}, 'g')"
_ENTITIES = {"&copy;?": "\u00a9", "&middot;?": "\u00b7", "&quot;?": '"', "&amp;?": "&"}


def _sql_unescaped(source: str) -> str:
    for name, char in _ENTITIES.items():
        source = f"regexp_replace({source}, '{name}', '{char}', 'g')"
    return source


@query(f"SELECT page_id, trim(regexp_replace({_sql_unescaped(_PLAIN_SQL)}, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html_text("html").alias("text"))


@query(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS a FROM pages),
p AS (SELECT page_id, url, {_sql_unescaped("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href, nullif(trim({_sql_unescaped("regexp_extract(a, '>([^<]*)</a>', 1)")}), '') AS text FROM a)
SELECT page_id, CASE WHEN href LIKE 'http%' THEN href ELSE regexp_extract(url, '^https?://[^/?#]+') || href END AS href, text, text AS context FROM p""")
def html_anchor_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(html_anchors("html", "url")).alias("a")).select("page_id", "a.*")


_SIBLING_SQL = f"""t AS (SELECT doc_ord, id, title, {_TITLE_SQL['base']} AS base, {_TITLE_SQL['version']} AS v, {_TITLE_SQL['stale']} AS mark,
  coalesce({_sql_field('Version')}, nullif(regexp_extract({_SCOPE_SQL}, 'version=([^;]*)', 1), '')) AS sv FROM kb),
n AS (SELECT *, CASE WHEN regexp_matches(v, '^\\d{{4}}$') THEN CAST(v AS BIGINT) END AS year, CASE WHEN NOT regexp_matches(v, '^\\d{{4}}$') THEN list_transform(regexp_extract_all(v, '\\d+'), lambda x: CAST(x AS BIGINT)) END AS num FROM t),
m AS (SELECT a.id, 'Title has stale suffix ''' || any_value(a.mark) || ''' and a newer page ''' || arg_min(b.title, b.doc_ord) || ''' exists in this scan' AS reason FROM n a JOIN n b ON a.base = b.base AND a.id <> b.id WHERE a.mark IS NOT NULL GROUP BY a.id),
o AS (SELECT a.id, 'Superseded by a related page in this scan: ''' || arg_min(b.title, b.doc_ord) || ''' (' || CASE WHEN any_value(a.year) IS NOT NULL THEN 'year' ELSE 'version' END || ' ' || arg_min(b.v, b.doc_ord) || ' > ' || any_value(a.v) || ')' AS reason
  FROM n a JOIN n b ON a.base = b.base AND a.id <> b.id AND (b.year > a.year OR b.num > a.num) WHERE a.mark IS NULL AND NOT coalesce(lower(a.sv) <> lower(b.sv), false) GROUP BY a.id),
sib AS (SELECT * FROM m UNION ALL SELECT * FROM o)"""


@query(f"WITH {KB_SQL}, {_SIBLING_SQL} SELECT id AS doc_id, reason FROM sib")
def scan_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.superseded(_prepared(spark, sf_dir))


@query(f"WITH {KB_SQL} SELECT id, substr(sha256(source_type || ':' || id || ':' || 'stale'), 1, 24) AS finding_key FROM kb")
def finding_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb(spark, sf_dir).select("id", T.finding_key(F.col("source_type"), F.col("id"), F.lit("stale")).alias("finding_key"))


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _raw(spark, sf_dir).withColumn("content_hash", T.content_hash(F.col("content")))
    return S.near_duplicates(docs).select("doc_id", "details.similar_to", "details.similarity")


@query()
def neighbour_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity score of each text and the one with the next id."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = documents.count()  # from the files' footers
    rows = documents.select("doc_id", compared_text(F.col("text")).alias("text"))
    following = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    pairs = dealt(rows, "doc_id", n, SCORED_ROWS).join(shuffled(dealt(following, "doc_id", n, SCORED_ROWS)), "doc_id")
    return pairs.select("doc_id", similarity_of("text", "other").alias("s")).select("doc_id", F.col("s.rounded").alias("similarity"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators over the pages: web probes and outdated versions too."""
    docs = kb(spark, sf_dir)
    return A.audit(docs, A.Settings(AS_OF, current_versions={"API": "v2.0"}, probes=_probes(docs)))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_audited(spark, sf_dir).withColumn("scan_id", F.lit(1).cast("long")), "query-results")


@query()
def audit_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, with all operators, and how many signals of each kind it has."""
    rows = _audited(spark, sf_dir)
    kinds = F.transform(F.array_sort(F.array_distinct("signals.signal_type")), lambda k: F.concat(k, F.lit(" "), F.size(F.filter("signals", lambda s: s["signal_type"] == k)).cast("string")))
    return rows.select(
        "document_id", "status", "confidence", "confidence_reason", "suggested_replacement_id", F.col("trust_metadata.lifecycle").alias("lifecycle"),
        F.col("trust_metadata.audit_priority").alias("audit_priority"), F.array_join(kinds, ", ").alias("signals"),
    )


@query()
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.report_counts(_results(spark, sf_dir))


@query()
def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.reference_summary(_results(spark, sf_dir)).select("document_id", "title", "status", F.size("outgoing").alias("n_outgoing"), F.array_join("incoming", "|").alias("incoming"))


@query()
def findings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings after two scans: in the second, pages with an id divisible by 7 have become current."""
    results = _results(spark, sf_dir)
    none = spark.createDataFrame([], W.FINDING)
    first = written(W.merge(none, results, 1, AS_OF, scanned=results).drop("change"), "query-findings")
    later = results.withColumn("status", F.when(F.col("document_id").cast("long") % 7 == 0, "current").otherwise(F.col("status")))
    return W.merge(first, later, 2, AS_OF + timedelta(days=1), scanned=later).select("finding_key", "document_id", "workflow_state", "change", "note", "first_seen_scan_id", "last_seen_scan_id", "last_checked_scan_id")


@query()
def findings_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _results(spark, sf_dir)
    merged = W.merge(spark.createDataFrame([], W.FINDING), results, 1, AS_OF, scanned=results).drop("change")
    return W.with_audit(W.queue(merged, AS_OF), results).select("finding_key", "document_id", "workflow_state", "status", "confidence")


# Signals, referrers and siblings by rules of a page's number, so that the classifier's rules meet one another.
def _any_sql(source: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({source}, {_quoted('|'.join(words))})"


def _cases_sql(clues, test: Callable[[str], str], at: int, put: int) -> str:
    return " ".join(f"WHEN {test(c[at])} THEN {_quoted(c[put])}" for c in clues)


def _in_text(source: str) -> Callable[[str], str]:
    return lambda pattern: f"regexp_matches({source}, {_quoted('(?i)' + pattern)})"


def _set_sql(*items: str) -> str:
    return f"list_filter(CAST([{', '.join(items)}] AS VARCHAR[]), lambda r: r IS NOT NULL)"


def _has_sql(reasons: str, *parts: str, source: str = "lower(r)") -> str:
    return f"len(list_filter({reasons}, lambda r: {' AND '.join(f'contains({source}, {_quoted(x)})' for x in parts)})) > 0"


_LOW_STATUS = lambda words: _any_sql("low", words)
_STATED_SQL = "'Status field indicates ''' || status_text || ''''"
_GUESS_SQL = "contains(lower(r), 'related page in this scan')"
_MARK_SQL = "contains(lower(r), 'stale suffix')"
_CADENCE_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.CADENCE_DAYS.items())
_VERDICT_SQL = f"""pm AS ({ORACLES['body_metadata']}),
x AS (SELECT doc_ord AS n, title, content, archived, last_modified, pm.*, lower(status_text) AS low, doc_ord % 4 AS inc, doc_ord % 3 = 0 AS ref,
  CAST(floor((epoch_us({_AS_OF_SQL}) - epoch_us(CAST(last_reviewed AS TIMESTAMP))) / 86400000000) AS INTEGER) AS days, CASE lower(trim(review_cadence)) {_CADENCE_SQL} END AS lim,
  CASE doc_ord % 13 WHEN 6 THEN 'Superseded by a related page in this scan: ''S'' (version v2 > v1)' WHEN 7 THEN 'Title has stale suffix ''(draft)'' and a newer page ''S'' exists in this scan' END AS sib FROM kb JOIN pm USING (id)),
y AS (SELECT *, {_set_sql("CASE WHEN n % 7 = 2 THEN 'Exact duplicate of ''D' || n || '''' END", "CASE WHEN n % 11 = 3 THEN 'Contains v1, but v2 exists in ''C' || n || '''' END", f"CASE WHEN {_LOW_STATUS(C.STALE_WORDS)} THEN {_STATED_SQL} END",
    f"CASE {_cases_sql(C.PHRASES, _in_text('content'), 0, 1)} END", "'Replaced by ''' || replaced_by || ''''", "'Deprecated as of ' || deprecated_as_of", "CASE WHEN archived THEN 'Source metadata indicates page is archived' END", "sib")} AS told,
  {_set_sql("CASE WHEN inc >= 2 THEN 'Referenced by ' || inc || ' other documents' END", f"CASE WHEN contains(low, 'current') THEN {_STATED_SQL} END", "CASE WHEN canonical THEN 'Marked as canonical document' END")} AS strong,
  {_set_sql(f"CASE WHEN NOT contains(low, 'current') AND {_LOW_STATUS(C.SUPPORT_WORDS)} THEN {_STATED_SQL} END", "CASE WHEN ref THEN 'All 1 outgoing references resolve correctly' END", "CASE WHEN n % 4 = 1 THEN 'All 1 internal links resolve correctly' END",
    "CASE WHEN days <= 180 THEN 'Last reviewed ' || last_reviewed END", "'Has designated owner: ' || owner")} AS further FROM x),
z AS (SELECT *, CASE WHEN len(strong) > 0 THEN list_concat(strong, further) ELSE [] END AS trust, list_filter(told, lambda r: NOT {_GUESS_SQL}) AS firm,
  list_filter(told, lambda r: NOT {_GUESS_SQL} AND NOT ({_MARK_SQL} AND regexp_matches(lower(r), '''draft''|\\(draft\\)'))) AS firmer,
  CASE WHEN archived THEN 'archived' WHEN replaced_by IS NOT NULL THEN 'superseded' WHEN deprecated_as_of IS NOT NULL THEN 'deprecated' {_cases_sql(C.NEGATIVE_STATUS, _LOW_STATUS, 0, 1)} ELSE
    coalesce(list_filter(list_transform(list_filter(told, lambda r: NOT {_GUESS_SQL} AND NOT {_MARK_SQL}), lambda r: CASE {_cases_sql(C.REASON_CLUES, lambda w: _any_sql('lower(r)', w), 0, 1)} END), lambda m: m IS NOT NULL)[1],
      CASE {_cases_sql(C.TITLE_CLUES, _in_text('title'), 0, 1)} {_cases_sql(C.BODY_CLUES, _in_text('content'), 0, 1)} {_cases_sql(C.POSITIVE_STATUS, _LOW_STATUS, 0, 1)}
      WHEN canonical THEN 'current' WHEN applies_to IS NOT NULL THEN 'supported' WHEN sib IS NOT NULL THEN 'superseded' ELSE 'unknown' END) END AS state FROM y),
u AS (SELECT *, CASE WHEN state IN ('experimental', 'draft') THEN firmer WHEN state IN ('supported', 'current') THEN firm ELSE told END AS stale,
  {_set_sql("CASE WHEN state IN ('deprecated', 'superseded', 'archived') AND len(trust) > 0 THEN 'Lifecycle is ''' || state || ''' but trust evidence exists — human review needed' END", "CASE WHEN state = 'supported' AND len(firm) < len(told) THEN 'Lifecycle is ''supported'' — scan-local version supersession suppressed' END")} AS against,
  {_set_sql("CASE WHEN n % 5 = 1 THEN 'Not modified in ' || n || ' days' END", "CASE WHEN n % 6 = 1 THEN 'Contains unresolved reference: Q' || n END", "CASE WHEN n % 9 = 4 THEN '86% similar to ''N' || n || '''' END", "CASE WHEN n % 8 = 3 THEN 'Contains 2 broken links' END",
    "CASE WHEN state IN ('experimental', 'draft') AND len(firmer) = 0 THEN 'Document lifecycle is ''' || state || ''' — needs review before relying on content' END", "CASE WHEN state = 'current' AND len(told) > 0 AND len(firm) = 0 THEN 'Lifecycle is ''current'' but inferred version supersession exists — needs review' END",
    "CASE WHEN days > 365 THEN 'Last reviewed ' || last_reviewed || ' (' || days || ' days ago)' END", "CASE WHEN days > lim THEN 'Review cadence is ''' || review_cadence || ''' but last reviewed ' || days || ' days ago (max ' || lim || ')' END")} AS risks FROM z),
v AS (SELECT *, len(trust) > 0 OR len(against) > 0 AS disputed, CASE WHEN len(stale) > 0 THEN CASE WHEN len(trust) > 0 OR len(against) > 0 THEN 'needs_review' ELSE 'stale' END WHEN len(risks) > 0 THEN 'needs_review' WHEN len(trust) > 0 THEN 'current' ELSE 'unknown' END AS status,
  lower(array_to_string(risks, ' ')) AS said, CASE WHEN NOT {_LOW_STATUS((*C.STALE_WORDS, 'current'))} THEN 'Status: ' || status_text END AS plain FROM u),
w AS (SELECT *, list_concat(risks, {_set_sql("CASE WHEN NOT regexp_matches(said, 'referenced by|incoming') THEN CASE inc WHEN 0 THEN 'No incoming references' WHEN 1 THEN 'Referenced by 1 document' ELSE 'Referenced by ' || inc || ' documents' END END",
    "CASE WHEN NOT contains(said, 'status') THEN plain END", "CASE WHEN NOT contains(said, 'resolve') AND ref THEN 'All 1 outgoing references resolve' END", "CASE WHEN NOT contains(said, 'owner') THEN 'Owner: ' || owner END")}[1:3]) AS noted,
  {_set_sql("CASE inc WHEN 0 THEN 'No incoming references from other documents' WHEN 1 THEN 'Only 1 incoming reference (minimum 2 needed for trust)' END", "CASE WHEN ref AND inc = 0 THEN 'Outgoing references resolve, but no documents reference this page' WHEN ref AND inc = 1 THEN 'Outgoing references resolve, but only 1 document references this page' END",
    "CASE WHEN last_reviewed IS NULL THEN 'No ''Last reviewed'' date in document body' END", "plain")} AS lacking,
  CASE n % 5 WHEN 1 THEN 15 WHEN 2 THEN 10 ELSE 0 END + CASE WHEN n % 7 = 2 THEN 45 ELSE 0 END + CASE WHEN n % 11 = 3 THEN 50 ELSE 0 END + CASE WHEN {_LOW_STATUS(C.STALE_WORDS)} THEN 30 ELSE 0 END + CASE WHEN {_has_sql('stale', 'Body text says', source='r')} THEN 30 ELSE 0 END
  + CASE WHEN {_has_sql('stale', 'archived', 'metadata')} THEN 25 ELSE 0 END + CASE WHEN {_has_sql('stale', 'superseded by a related page')} THEN 25 ELSE 0 END + CASE WHEN {_has_sql('stale', 'replaced by')} THEN 35 ELSE 0 END + CASE WHEN {_has_sql('stale', 'deprecated as of')} THEN 30 ELSE 0 END AS points FROM v),
s AS (SELECT *, greatest(30, least(95, points + CASE WHEN n % 5 IN (1, 2) AND points > 10 THEN 10 ELSE 0 END)) AS score, CASE WHEN len(stale) > 0 AND disputed THEN list_concat(['Contradictory evidence: stale signals conflict with trust signals'], against, stale, trust)
  WHEN len(stale) > 0 THEN stale WHEN len(risks) > 0 THEN noted WHEN len(trust) > 0 THEN trust WHEN len(lacking) > 0 THEN lacking ELSE ['Insufficient positive trust evidence'] END AS reasons FROM w)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified pages whose signals, referrers and siblings follow from their number."""
    n = F.col("doc_ord")
    numbered = lambda letter: F.concat(F.lit(letter), n)

    def signal(holds, kind: str, severity="warning", **found) -> Column:
        row = {"signal_type": F.lit(kind), "severity": F.lit(severity) if isinstance(severity, str) else severity, "message": F.lit(kind), "details": schema.details(**found)}
        return F.when(holds, F.struct(*[v.alias(k) for k, v in row.items()]))

    signals = F.array_compact(F.array(
        signal((n % 5).isin(1, 2), "age", F.when(n % 5 == 1, "critical").otherwise("warning"), age_days=n),
        signal(n % 7 == 2, "duplicate", "critical", duplicate_title=numbered("D")),
        signal(n % 11 == 3, "version_marker", "critical", found_version=F.lit("v1"), current_version=F.lit("v2"), current_doc_title=numbered("C")),
        signal(n % 6 == 1, "unresolved_reference", referenced_title=numbered("Q")), signal(n % 9 == 4, "near_duplicate", similarity=F.lit(85.5), similar_title=numbered("N")),
        signal(n % 8 == 3, "broken_link"), signal(n % 8 == 3, "broken_link"), signal(n % 3 == 0, "resolved_reference", "info"), signal(n % 4 == 1, "resolved_internal_link", "info"),
    ))
    sibling = F.when(n % 13 == 6, "Superseded by a related page in this scan: 'S' (version v2 > v1)").when(n % 13 == 7, "Title has stale suffix '(draft)' and a newer page 'S' exists in this scan")
    docs = _prepared(spark, sf_dir).withColumns({"signals": signals, "incoming": (n % 4).cast("int"), "sibling_reason": sibling})
    return C.classify(docs, AS_OF)


@query(f"""WITH {KB_SQL}, {_VERDICT_SQL} SELECT id, status, state AS lifecycle, array_to_string(reasons, '; ') AS confidence_reason,
  CAST(CASE WHEN len(stale) > 0 THEN CASE WHEN disputed THEN least(70, score) ELSE score END
    WHEN len(risks) > 0 THEN least(90, 35 + CASE WHEN n % 6 = 1 THEN 10 ELSE 0 END + CASE WHEN n % 8 = 3 THEN 16 ELSE 0 END + CASE WHEN n % 9 = 4 THEN 15 ELSE 0 END + CASE WHEN n % 5 = 1 THEN 10 ELSE 0 END
      + CASE WHEN {_has_sql('reasons', 'Status field', source='r')} THEN 15 ELSE 0 END + CASE WHEN {_has_sql('reasons', 'Last reviewed', source='r')} THEN 10 ELSE 0 END)
    WHEN len(trust) > 0 THEN least(100, 50 + list_sum(list_transform(trust, lambda r: CASE WHEN starts_with(r, 'Referenced by') THEN 10 + 4 * least(inc, 5) WHEN contains(r, 'Status field indicates') THEN CASE WHEN contains(r, 'Current') THEN 12 ELSE 5 END
      WHEN r = 'Marked as canonical document' THEN 15 WHEN contains(r, 'outgoing references resolve') THEN 5 WHEN contains(r, 'Last reviewed') THEN 10 WHEN contains(r, 'designated owner') THEN 6 ELSE 0 END)))
    WHEN last_modified IS NULL THEN 15 ELSE 25 END AS INTEGER) AS confidence_hundredths FROM s""")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's verdicts on pages whose signals, referrers and siblings are given."""
    return _verdicts(spark, sf_dir).select("id", "status", F.col("lifecycle.state").alias("lifecycle"), "confidence_reason", "confidence_hundredths")


_LACKING = {"inc = 0": "No incoming references from other documents", "last_reviewed IS NULL": "No 'Last reviewed' date in document body", "owner IS NULL": "No owner or DRI specified",
            "status_text IS NULL": "No status field in document body", "review_cadence IS NULL": "No review cadence specified"}


@query(f"""WITH {KB_SQL}, {_VERDICT_SQL}
SELECT id, array_to_string({_set_sql(*[f"CASE WHEN {test} THEN {_quoted(text)} END" for test, text in _LACKING.items()])}, '; ') AS missing_evidence,
  CASE WHEN status IN ('current', 'unknown') THEN '' WHEN len(stale) > 0 THEN array_to_string(stale, '; ') ELSE array_to_string(risks, '; ') END AS review_risks FROM s""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classified pages lack, and what speaks against them."""
    return _verdicts(spark, sf_dir).select("id", F.array_join("missing_evidence", "; ").alias("missing_evidence"), F.array_join("review_risks", "; ").alias("review_risks"))


_NEED_SQL = f"""a AS (SELECT *, CASE WHEN len(stale) > 0 THEN stale ELSE risks END AS shown, n % 7 = 2 OR n % 6 = 1 OR n % 9 = 4 OR n % 8 = 3 OR n % 5 = 1 AS hard, {_set_sql(
    "CASE WHEN inc >= 2 THEN 'Referenced by ' || inc || ' documents (+2)' WHEN inc = 1 THEN 'Referenced by 1 document (+1)' END", "CASE WHEN owner IS NOT NULL THEN 'Has designated owner (+1)' END",
    "CASE WHEN status_text IS NOT NULL THEN 'Has declared status field (+1)' END", "CASE WHEN state <> 'unknown' THEN 'Lifecycle is ''' || state || ''' (+1)' END",
    "CASE WHEN canonical THEN 'Marked as canonical (+2)' END", "CASE WHEN applies_to IS NOT NULL THEN 'Has applicability scope (+1)' END",
    "CASE n % 3 WHEN 0 THEN CASE WHEN n % 5 < 3 THEN 'Part of a version family (+1)' END WHEN 1 THEN 'Suggested replacement for 1 stale document (+2)' ELSE 'Suggested replacement for 2 stale documents (+2)' END")} AS why FROM s),
b AS (SELECT *, CAST(coalesce(list_sum(list_transform(why, lambda r: CAST(right(r, 2)[1] AS INTEGER))), 0) AS INTEGER) AS worth FROM a),
k AS (SELECT *, CASE WHEN status = 'current' THEN 1 WHEN status = 'stale' THEN 2 WHEN state IN {(*C.ENDED, *C.UNFINISHED)} THEN 3 WHEN hard THEN 4 WHEN {_has_sql('shown', 'review cadence')} THEN 5 WHEN worth >= {schema.IMPORTANCE_THRESHOLD} THEN 6 WHEN worth > 0 THEN 7 ELSE 8 END AS kind FROM b)"""


@query(f"""WITH {KB_SQL}, {_VERDICT_SQL}, {_NEED_SQL} SELECT id, kind BETWEEN 2 AND 6 AS requires_human_audit, CASE kind WHEN 6 THEN 'medium' WHEN 7 THEN 'low' WHEN 1 THEN 'none' WHEN 8 THEN 'none' ELSE 'high' END AS audit_priority,
  CASE WHEN kind > 5 THEN worth ELSE 0 END AS importance_score, CASE WHEN kind > 5 THEN array_to_string(why, '; ') ELSE '' END AS importance_reasons,
  CASE kind WHEN 1 THEN 'Document is current — no audit required' WHEN 2 THEN 'Document is stale' WHEN 3 THEN 'Lifecycle is ''' || state || ''' — always requires review' WHEN 4 THEN 'Has hard review risk (broken links, unresolved references, etc.)'
    WHEN 5 THEN 'Review cadence is overdue' WHEN 6 THEN 'Important document requiring review (score ' || worth || ')' ELSE 'Insufficient importance signals to require audit (score ' || worth || ')' END AS actionability_reason FROM k""")
def audit_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the classified pages a person should look at, and why, with votes and families given by rules."""
    n = F.col("doc_ord")
    rows = _verdicts(spark, sf_dir).withColumns({"stale_votes": (n % 3).cast("int"), "has_siblings": n % 5 < 3})
    return rows.select("id", C.actionability().alias("a")).select(
        "id", "a.requires_human_audit", "a.audit_priority", "a.importance_score", F.array_join("a.importance_reasons", "; ").alias("importance_reasons"), "a.actionability_reason"
    )


# A workspace as landed responses, by rules of a page's number: a tree of pages, entries of databases, nodes without a text, databases in texts.
_PAGE_ID = "'00000000-0000-0000-0000-' || lpad(CAST({n} AS VARCHAR), 12, '0')"
_WORKSPACE_SQL = f"""p AS (SELECT doc_id AS n, {_PAGE_ID.format(n="doc_id")} AS id, CASE WHEN doc_id % 6 = 0 THEN 'Node ' || (doc_id // 6) ELSE 'Guide ' || (doc_id // 4) || ' v' || (doc_id % 4 + 1) END AS title,
  CASE WHEN doc_id % 5 = 0 THEN 'db' || (doc_id % 7) ELSE {_PAGE_ID.format(n="doc_id // 3")} END AS up, doc_id % 6 <> 0 AS shown, CASE WHEN doc_id % 11 = 3 THEN 'db' || (doc_id % 7) END AS inline FROM documents),
k AS (SELECT *, trim(regexp_replace(lower(title), '\\s*\\bv\\d+\\s*$', '')) AS key FROM p)"""


def _tree_sql(name: str, root: str) -> str:
    return f"{name}(id, depth) AS (SELECT id, 0 FROM p WHERE id = {root} UNION ALL SELECT p.id, t.depth + 1 FROM {name} t JOIN p ON p.up = t.id AND p.id <> t.id WHERE t.depth < 100)"


def _related_sql(name: str) -> str:
    return f"""{name}_seen AS (SELECT id FROM k WHERE shown AND (id IN (SELECT id FROM {name}) OR up IN (SELECT inline FROM k WHERE id IN (SELECT id FROM {name}) AND inline IS NOT NULL))),
{name}_all AS (SELECT id FROM k WHERE shown AND (id IN (SELECT id FROM {name}_seen) OR key IN (SELECT key FROM k WHERE id IN (SELECT id FROM {name}_seen))))"""


@query(f"""WITH RECURSIVE {_WORKSPACE_SQL}, {_tree_sql("root", _PAGE_ID.format(n=2))}, {_tree_sql("node", _PAGE_ID.format(n=6))}, {_tree_sql("blank", _PAGE_ID.format(n=12))}, {_related_sql("node")}, {_related_sql("blank")}
SELECT 'database' AS scope, id FROM k WHERE shown AND up = 'db3' UNION ALL SELECT 'root', id FROM k WHERE shown AND id IN (SELECT id FROM root)
UNION ALL SELECT 'title', id FROM k WHERE shown AND contains(lower(title), 'guide 7') UNION ALL SELECT 'node', id FROM node_all UNION ALL SELECT 'blank address', id FROM blank_all
UNION ALL SELECT 'address', id FROM k WHERE shown AND key = 'guide 4' UNION ALL SELECT 'all', id FROM k WHERE shown""")
def search_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a text that each kind of scope finds in a workspace."""
    n = F.col("doc_id")
    page_id = lambda c: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.floor(c).cast("string"), 12, "0"))
    database = F.concat(F.lit("db"), (n % 7).cast("string"))
    title = F.when(n % 6 == 0, F.concat(F.lit("Node "), F.floor(n / 6))).otherwise(F.concat(F.lit("Guide "), F.floor(n / 4), F.lit(" v"), n % 4 + 1))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    none = F.lit(None).cast("string")
    parent = F.struct(F.when(n % 5 == 0, "database_id").otherwise("page_id").alias("type"), F.when(n % 5 != 0, page_id(n / 3)).alias("page_id"), F.when(n % 5 == 0, database).alias("database_id"))
    shown = F.create_map(F.lit("Name"), F.struct(F.lit("title").alias("type"), F.array(F.struct(title.alias("plain_text"))).alias("title")))
    actor = F.struct(none.alias("id"))
    pages = rows.select(
        page_id(n).alias("id"), none.alias("url"), none.alias("last_edited_time"), none.alias("created_time"), actor.alias("created_by"), actor.alias("last_edited_by"), parent.alias("parent"),
        F.lit(False).alias("archived"), shown.alias("properties"), F.struct(none.alias("title")).alias("child_page"),
    )
    said = F.array(F.struct(F.lit("Some text.").alias("plain_text"), none.alias("href"), F.struct(F.struct(none.alias("url")).alias("link")).alias("text")))
    data = F.from_json(F.lit("{}"), dict(x.split(" ", 1) for x in L.BLOCK.split(", "))["data"])
    block = lambda id_, at, kind, d: rows.select(id_.alias("id"), page_id(n).alias("parent_id"), F.lit(at).cast("long").alias("position"), F.lit(kind).alias("type"), F.lit(False).alias("has_children"), d.alias("data"), "doc_id")
    blocks = block(page_id(n + 10**9), 1, "paragraph", data.withField("rich_text", said)).where(n % 6 != 0).unionByName(block(database, 2, "child_database", data).where(n % 11 == 3)).drop("doc_id")
    pages, blocks = written(pages, "query-pages"), written(blocks, "query-blocks")
    address = lambda k: f"https://www.notion.so/P-{k:032d}"
    asked = {
        "database": {"database": "db3"}, "root": {"root": f"00000000-0000-0000-0000-{2:012d}"}, "title": {"query": "guide 7"}, "node": {"query": "NODE 1"},
        "address": {"query": address(17)}, "blank address": {"query": address(12)}, "all": {},
    }
    shown_ = L.page_contents(pages, blocks).where(F.col("content") != "").select(F.col("page_id").alias("id"))
    found = [scopes.workspace(pages, blocks, **scope).join(shuffled(shown_), "id", "left_semi").select(F.lit(name).alias("scope"), "id") for name, scope in asked.items()]
    return reduce(DataFrame.union, found)


# Verdicts, references and suggestions by rules of a page's number, so that what pages say about one another has an exact counterpart.
_GIVEN_SQL = """d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS id, doc_id // 3 AS base, CASE WHEN doc_id % 4 < 2 THEN 'stale' WHEN doc_id % 8 = 2 THEN 'unknown' ELSE 'current' END AS status,
  CASE WHEN doc_id % 17 = 0 THEN 'Status: Current' END AS status_text, doc_id % 13 = 0 AS canonical, CASE WHEN doc_id % 10 = 6 THEN ['r' || doc_id] ELSE [] END AS risks FROM documents),
edge AS (SELECT CAST(n AS VARCHAR) AS source, CAST(n + step AS VARCHAR) AS target FROM d, (VALUES (1), (2), (3)) v(step) WHERE n % 7 <> 0 AND (n + step) % 5 <> 4),
heard AS (SELECT target AS id, count(*) AS referrers, count(*) FILTER (status = 'stale') AS stale_referrers FROM edge JOIN d ON d.id = edge.source GROUP BY target),
one AS (SELECT d.*, coalesce(referrers >= 2 AND referrers = stale_referrers AND status = 'current' AND NOT canonical AND status_text IS NULL, false) AS doubted, referrers FROM d LEFT JOIN heard USING (id)),
two AS (SELECT n, id, base, risks, doubted, referrers, CASE WHEN doubted THEN 'needs_review' ELSE status END AS status FROM one),
signal AS (SELECT id, status, 0 AS k, n + 3 AS said, true AS replaces FROM two WHERE n % 5 = 1 UNION ALL SELECT id, status, 1, n - 1, true FROM two WHERE n % 6 = 2 UNION ALL SELECT id, status, 2, n + 2, false FROM two WHERE n % 4 = 0),
named AS (SELECT s.*, CAST(said AS VARCHAR) AS target FROM signal s WHERE said IN (SELECT n FROM d)),
suggestion AS (SELECT id, arg_min(target, k) AS suggested FROM named WHERE replaces GROUP BY id),
vote AS (SELECT target AS id, count(*) AS votes FROM (SELECT id, arg_min(target, k) AS target FROM named WHERE status = 'stale' GROUP BY id) GROUP BY target),
family AS (SELECT base, count(*) > 1 AS has_siblings FROM d GROUP BY base),
three AS (SELECT two.*, suggested, coalesce(votes, 0) AS votes, has_siblings, n % 9 = 0 OR n % 5 = 1 OR n % 11 = 0 AS hard FROM two LEFT JOIN suggestion USING (id) LEFT JOIN vote USING (id) JOIN family USING (base)),
kind AS (SELECT *, CASE WHEN votes > 0 AND status = 'current' THEN 1 WHEN votes > 0 AND status = 'unknown' AND NOT hard AND len(risks) = 0 THEN 2 ELSE 0 END AS was,
  'Latest version among ' || (votes + 1) || ' related pages in this scan' AS latest, votes || ' older version' || CASE WHEN votes <> 1 THEN 's' ELSE '' END AS older,
  'All ' || referrers || ' incoming references are from stale documents' AS doubt FROM three)"""


@query(f"""WITH {_GIVEN_SQL}
SELECT id, CASE WHEN was = 2 THEN 'current' ELSE status END AS status, suggested, CAST(votes AS INTEGER) AS stale_votes, has_siblings,
  CAST(CASE was WHEN 1 THEN 100 WHEN 2 THEN CASE WHEN votes = 1 THEN 75 ELSE least(85, 75 + 5 * votes) END ELSE CASE WHEN doubted THEN 50 ELSE 40 END END AS INTEGER) AS confidence_hundredths,
  CASE was WHEN 1 THEN votes || ' other version' || CASE WHEN votes <> 1 THEN 's' ELSE '' END || ' identified as stale relative to this document' WHEN 2 THEN latest || '; supersedes ' || older ELSE CASE WHEN doubted THEN doubt ELSE 'given' END END AS confidence_reason,
  CASE was WHEN 0 THEN 'p' WHEN 1 THEN 'p; ' || latest || '; Supersedes ' || older ELSE latest || '; Supersedes ' || older END AS positive_evidence,
  CASE WHEN was = 2 THEN '' ELSE array_to_string(CASE WHEN doubted THEN list_append(risks, doubt) ELSE risks END, '; ') END AS review_risks,
  CASE WHEN was > 0 THEN 'Recommended because this is the latest version among related pages in this scan.' WHEN doubted THEN 'Needs review because all incoming references are from stale documents.' ELSE 's' END AS summary,
  CASE WHEN was = 2 THEN {_quoted(C.ACTIONS['current'])} WHEN doubted THEN {_quoted(C.ACTIONS['needs_review'])} ELSE 'a' END AS recommended_action FROM kind""")
def cross_page_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say about one another: only stale referrers, suggested replacements, votes of stale pages, promotions, families."""
    n = F.col("n")
    text = lambda c: c.cast("string")

    def signal(holds: Column, kind: str, severity: str = "warning", **found) -> Column:
        row = {"signal_type": F.lit(kind), "severity": F.lit(severity), "message": F.lit(kind), "details": schema.details(**found)}
        return F.when(holds, F.struct(*[v.alias(k) for k, v in row.items()]))

    signals = F.array_compact(F.array(
        signal(n % 5 == 1, "duplicate", duplicate_of=text(n + 3)), signal(n % 6 == 2, "version_note", similar_to=text(n - 1)), signal(n % 4 == 0, "version_marker", current_doc_id=text(n + 2)),
        signal(n % 9 == 0, "broken_link"), signal(n % 11 == 0, "age", "critical"),
    ))
    pm = F.struct(F.when(n % 17 == 0, "Status: Current").alias("status_text"), (n % 13 == 0).alias("canonical"))
    none = F.array().cast("array<string>")
    values = {
        "id": text(n), "base": text(F.floor(n / 3)), "status": F.when(n % 4 < 2, "stale").when(n % 8 == 2, "unknown").otherwise("current"), "pm": pm, "signals": signals, "confidence_hundredths": F.lit(40),
        "confidence_reason": F.lit("given"), "positive_evidence": F.array(F.lit("p")), "review_risks": F.when(n % 10 == 6, F.array(F.concat(F.lit("r"), n))).otherwise(none), "summary": F.lit("s"), "recommended_action": F.lit("a"),
    }
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("n"))
    rows = written(ids.select(*[v.alias(k) for k, v in values.items()]), "query-given")
    edges = ids.where(n % 7 != 0).select("n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step")).where((n + F.col("step")) % 5 != 4)
    edges = edges.select(text(n).alias("source"), text(n + F.col("step")).alias("target"), F.lit("resolved_reference").alias("kind"))
    found = A.corrected(rows, edges, rows)
    kept = ("id", "status", "suggested", "stale_votes", "has_siblings", "confidence_hundredths", "confidence_reason", "summary", "recommended_action")
    return found.select(*kept, *[F.array_join(c, "; ").alias(c) for c in ("positive_evidence", "review_risks")])


# Stored scans are given as small derived tables, so that their queries have exact counterparts.
_SCAN_SQL = """r AS (SELECT s AS scan_id, CAST(doc_id AS VARCHAR) AS document_id, 'T' || doc_id AS title, CASE (doc_id * 7 + s * (doc_id % 5)) % 4 WHEN 0 THEN 'stale' WHEN 1 THEN 'current' WHEN 2 THEN 'needs_review' ELSE 'unknown' END AS status,
  CAST(doc_id % 100 AS DOUBLE) / 100 AS confidence, 'because ' || doc_id AS confidence_reason FROM documents, (VALUES (1), (2), (3)) v(s) WHERE doc_id % 11 <> s)"""


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    rows = ids.select("doc_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("scan_id")).where(F.col("doc_id") % 11 != F.col("scan_id"))
    state = F.element_at(F.array(*map(F.lit, ("stale", "current", "needs_review", "unknown"))), ((F.col("doc_id") * 7 + F.col("scan_id") * (F.col("doc_id") % 5)) % 4 + 1).cast("int"))
    results = rows.select("scan_id", F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("T"), F.col("doc_id")).alias("title"), state.alias("status"), (F.col("doc_id") % 100 / 100).alias("confidence"), F.concat(F.lit("because "), F.col("doc_id")).alias("confidence_reason"))
    scans = spark.createDataFrame([(i, AS_OF, AS_OF, 0, "completed", None) for i in (1, 2, 3)], "scan_id long, started_at timestamp, finished_at timestamp, document_count long, status string, error string")
    return scans, results


@query(f"WITH {_SCAN_SQL} SELECT document_id, row_number() OVER (ORDER BY CASE status WHEN 'stale' THEN 0 WHEN 'needs_review' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, confidence, document_id) - 1 AS place FROM r WHERE scan_id = 3")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a report lists each page of a scan."""
    return numbered(_scans(spark, sf_dir)[1].where("scan_id = 3"), H.report_order(), "place").select("document_id", "place")


@query(f"WITH {_SCAN_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'current') AS current FROM r WHERE scan_id = 2")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's counts of a scan."""
    return H.report_counts(_scans(spark, sf_dir)[1].where("scan_id = 2"))


# References as a scan stores them, by rules of a page's number: to one page, to two, or to none.
_LISTING_SQL = """d AS (SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS id, 'T' || doc_id AS title FROM documents),
sig AS (SELECT n, id, title, 0 AS k, 'resolved' AS state, 'T' || (n + 1) AS said, CAST(n + 1 AS VARCHAR) AS target, [n + 1] AS pages FROM d WHERE n % 3 = 0
  UNION ALL SELECT n, id, title, 1, 'ambiguous', 'U' || n, NULL, [n + 2, n + 4] FROM d WHERE n % 4 = 1 UNION ALL SELECT n, id, title, 2, 'unresolved', 'V' || n, NULL, [] FROM d WHERE n % 5 = 2),
outgoing AS (SELECT id, string_agg(state || ':' || said || ':' || coalesce(target, '-'), '|' ORDER BY k) AS outgoing FROM sig GROUP BY id),
incoming AS (SELECT CAST(t AS VARCHAR) AS id, string_agg(title, '|' ORDER BY title) AS incoming FROM (SELECT title, unnest(pages) AS t FROM sig) GROUP BY t)"""


@query(f"WITH {_LISTING_SQL} SELECT id AS document_id, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming FROM d LEFT JOIN outgoing USING (id) LEFT JOIN incoming USING (id)")
def reference_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages a page refers to and which refer to it, from the signals of a stored scan."""
    n = F.col("doc_id")
    said = lambda letter, c=n: F.concat(F.lit(letter), c.cast("string"))

    def signal(holds: Column, state: str, **found) -> Column:
        row = {"signal_type": F.lit(f"{state}_reference"), "severity": F.lit("info"), "message": F.lit(state), "details": schema.details(**found)}
        return F.when(holds, F.struct(*[v.alias(k) for k, v in row.items()]))

    several = F.array((n + 2).cast("string"), (n + 4).cast("string"))
    signals = F.array_compact(F.array(
        signal(n % 3 == 0, "resolved", referenced_title=said("T", n + 1), resolved_doc_id=(n + 1).cast("string")),
        signal(n % 4 == 1, "ambiguous", referenced_title=said("U"), matching_doc_ids=several), signal(n % 5 == 2, "unresolved", referenced_title=said("V")),
    ))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(n.cast("string").alias("document_id"), said("T").alias("title"), F.lit("current").alias("status"), signals.alias("signals"))
    shown = F.transform("outgoing", lambda r: F.concat_ws(":", r["state"], r["title"], F.coalesce(r["target"], F.lit("-"))))
    return H.reference_summary(rows).select("document_id", F.array_join(shown, "|").alias("outgoing"), F.array_join("incoming", "|").alias("incoming"))


_DIFF_SQL = "SELECT n.document_id, n.title, o.status AS old_status, n.status AS new_status, n.confidence, n.confidence_reason FROM r n LEFT JOIN r o ON o.document_id = n.document_id AND o.scan_id = n.scan_id - 1 WHERE {where} AND (o.status IS NULL OR o.status <> n.status)"


@query(f"WITH {_SCAN_SQL} {_DIFF_SQL.format(where='n.scan_id = 3')}")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.scan_diff(_scans(spark, sf_dir)[1], 3, 2)


@query(f"""WITH {_SCAN_SQL}, c AS (SELECT scan_id, count(*) FILTER (status = 'stale') AS stale_count, count(*) FILTER (status = 'needs_review') AS needs_review_count, count(*) FILTER (status = 'unknown') AS unknown_count FROM r GROUP BY scan_id),
d AS (SELECT n.scan_id, count(*) FILTER (o.status IS NULL) AS a, count(*) FILTER (o.status IS NOT NULL AND n.status = 'stale') AS s, count(*) FILTER (o.status IS NOT NULL AND n.status = 'needs_review') AS w, count(*) FILTER (o.status IS NOT NULL AND n.status = 'current') AS k, count(*) FILTER (o.status IS NOT NULL AND n.status = 'unknown') AS u
  FROM r n LEFT JOIN r o ON o.document_id = n.document_id AND o.scan_id = n.scan_id - 1 WHERE n.scan_id > 1 AND (o.status IS NULL OR o.status <> n.status) GROUP BY n.scan_id)
SELECT c.*, concat_ws('; ', CASE WHEN a > 0 THEN a || ' document' || CASE WHEN a <> 1 THEN 's' ELSE '' END || ' added' END, CASE WHEN s > 0 THEN s || ' document' || CASE WHEN s <> 1 THEN 's' ELSE '' END || ' became stale' END,
  CASE WHEN w > 0 THEN w || ' document' || CASE WHEN w <> 1 THEN 's' ELSE '' END || ' needs review' END, CASE WHEN k > 0 THEN k || ' document' || CASE WHEN k <> 1 THEN 's' ELSE '' END || ' became current' END,
  CASE WHEN u > 0 THEN u || ' document' || CASE WHEN u <> 1 THEN 's' ELSE '' END || ' became unknown' END) AS changes FROM c LEFT JOIN d USING (scan_id)""")
def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.scan_history(*_scans(spark, sf_dir))
    return rows.select("scan_id", "stale_count", "needs_review_count", "unknown_count", F.coalesce(F.array_join("changes", "; "), F.lit("")).alias("changes"))


@query(f"WITH {_SCAN_SQL} SELECT 4 AS scan_id, document_id, title, status, confidence, confidence_reason FROM r WHERE scan_id = 3 AND CAST(document_id AS BIGINT) % 2 = 0")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _scans(spark, sf_dir)[1].where("scan_id = 3")
    ids = results.where(F.col("document_id").cast("long") % 2 == 0).select("document_id")
    return H.carried(results, 4, ids).drop("suggested_replacement_id")


@query("""WITH s AS (SELECT doc_id AS scan_id, CASE WHEN doc_id % 10 = 3 THEN 'running' ELSE 'completed' END AS status FROM documents)
SELECT scan_id FROM (SELECT scan_id, row_number() OVER (ORDER BY scan_id DESC) AS n FROM s WHERE status <> 'running') WHERE n > 20""")
def expired_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("doc_id") % 10 == 3, "running").otherwise("completed")
    return H.expired_scans(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("scan_id"), state.alias("status")))


# Findings of the third scan, by rules of their page's number.
_STATE_LIST = ("open", "acknowledged", "snoozed", "accepted_risk", "dismissed", "fixed")
_FINDING_SQL = f"""f AS (SELECT substr(sha256('kb:' || doc_id || ':' || CASE WHEN doc_id % 2 = 0 THEN 'stale' ELSE 'needs_review' END), 1, 24) AS finding_key, CAST(doc_id AS VARCHAR) AS document_id,
  {list(_STATE_LIST)}[doc_id % 6 + 1] AS workflow_state, CASE WHEN doc_id % 6 = 2 THEN {_AS_OF_SQL} + to_days(CAST(doc_id % 5 - 2 AS INTEGER)) END AS snoozed_until,
  CASE WHEN doc_id % 4 = 1 THEN 'note ' || doc_id END AS note, 2 + doc_id % 2 AS checked FROM documents),
g AS (SELECT *, workflow_state NOT IN ('accepted_risk', 'dismissed', 'fixed') AND NOT (workflow_state = 'snoozed' AND coalesce(snoozed_until > {_AS_OF_SQL}, false)) AS act FROM f)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    none = F.lit(None).cast("string")
    status = F.when(n % 2 == 0, "stale").otherwise("needs_review")
    asleep = F.timestamp_add("DAY", (n % 5 - 2).cast("int"), F.lit(AS_OF))
    values = {
        "finding_key": T.finding_key(F.lit("kb"), n.cast("string"), status), "document_id": n.cast("string"), "source_type": F.lit("kb"), "title": F.concat(F.lit("T"), n),
        "workflow_state": F.element_at(F.array(*map(F.lit, _STATE_LIST)), (n % 6 + 1).cast("int")), "note": F.when(n % 4 == 1, F.concat(F.lit("note "), n)),
        "assigned_owner": none, "due_date": none, "snoozed_until": F.when(n % 6 == 2, asleep), "dismissal_reason": none, "evidence_hash": none,
        "first_seen_scan_id": n % 3 + 1, "last_seen_scan_id": n % 2 + 2, "last_checked_scan_id": n % 2 + 2, "updated_at": F.lit(AS_OF),
    }
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[v.alias(k) for k, v in values.items()])


@query(f"""WITH {_FINDING_SQL}, s AS (SELECT 'all' AS asked, workflow_state FROM g UNION ALL SELECT 'scan 3', workflow_state FROM g WHERE checked = 3 UNION ALL SELECT 'to do', workflow_state FROM g WHERE act)
SELECT asked, workflow_state, count(*) AS n FROM s GROUP BY ALL""")
def workflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir)
    asked = {"all": (None, None, True), "scan 3": (None, 3, True), "to do": (AS_OF, None, False)}
    found = [W.state_counts(rows, *a).select(F.lit(k).alias("asked"), "workflow_state", "n") for k, a in asked.items()]
    return found[0].union(found[1]).union(found[2])


@query(f"""WITH {_SCAN_SQL}, {_FINDING_SQL}
SELECT r.document_id, r.status, g.finding_key, g.workflow_state AS state, CASE WHEN g.finding_key IS NOT NULL THEN coalesce(g.note, '') END AS note, g.act AS is_actionable
FROM r LEFT JOIN g ON g.checked = 3 AND g.finding_key = substr(sha256('kb:' || r.document_id || ':' || r.status), 1, 24) WHERE r.scan_id = 3""")
def results_with_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _scans(spark, sf_dir)[1].withColumn("source_type", F.lit("kb"))
    rows = W.results_with_workflow(results, _findings(spark, sf_dir), AS_OF, 3)
    return rows.select("document_id", "status", "workflow.finding_key", "workflow.state", "workflow.note", "workflow.is_actionable")


@query(f"WITH {_FINDING_SQL} SELECT finding_key, document_id, workflow_state FROM g WHERE act AND checked = 3")
def workflow_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.queue(_findings(spark, sf_dir), AS_OF, scan_id=3).select("finding_key", "document_id", "workflow_state")


@query(f"""WITH {_SCAN_SQL}, {_FINDING_SQL}, q AS (SELECT *, 2 + CAST(document_id AS BIGINT) % 2 AS last_seen FROM g)
SELECT q.finding_key, q.document_id, row_number() OVER (ORDER BY list_position({list(schema.WORKFLOW_STATES)}, workflow_state), q.finding_key) - 1 AS place, r.status, r.confidence
FROM q LEFT JOIN r ON r.document_id = q.document_id AND r.scan_id = q.last_seen""")
def queue_with_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in the queue's order, with what the scan that saw them last says about their page."""
    results = _scans(spark, sf_dir)[1]
    for column in ("url", "trust_metadata", "trust_evidence", "suggested_replacement_id"):
        results = results.withColumn(column, F.lit(None).cast("string"))
    rows = W.with_audit(W.queue(_findings(spark, sf_dir), AS_OF, include_all=True), results)
    return numbered(rows, W.queue_order(), "place").select("finding_key", "document_id", "place", "status", "confidence")


@query(f"""WITH {_FINDING_SQL} SELECT finding_key, CASE WHEN document_id = '8' THEN 'dismissed' ELSE workflow_state END AS workflow_state, CASE WHEN document_id <> '8' THEN snoozed_until END AS snoozed_until,
  CASE WHEN document_id = '8' THEN 'known' ELSE note END AS note FROM g""")
def finding_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings after one of them, a snoozed one, is dismissed."""
    rows = _findings(spark, sf_dir)
    key = rows.where("document_id = '8'").agg(F.max("finding_key")).first()[0]
    return rows.select("finding_key", "workflow_state", "snoozed_until", "note") if key is None else W.update(rows, key, AS_OF, state="dismissed", note="known").select("finding_key", "workflow_state", "snoozed_until", "note")


# Results of a fourth scan, by rules of their page's number: seen findings, new ones, and pages that have become current.
_FOURTH_SQL = """e AS (SELECT doc_id AS n, CASE WHEN doc_id % 8 = 5 THEN 'unknown' WHEN doc_id % 4 = 0 THEN 'stale' WHEN doc_id % 4 = 3 THEN 'current' ELSE 'needs_review' END AS status,
  CASE doc_id % 10 WHEN 5 THEN true WHEN 9 THEN false END AS flag FROM documents WHERE doc_id % 11 <> 4),
h AS (SELECT *, CAST(n AS VARCHAR) AS page, substr(sha256(concat_ws('|', status, CASE WHEN n % 3 = 0 THEN 'age:critical:' || n || ' days:age_days=' || n || ';matching_doc_ids=[' || n || ',b]' END,
  'sum ' || status, 'x', 'y', CASE WHEN n % 2 = 0 THEN 'm' END, 'act')), 1, 16) AS hash FROM e),
seen AS (SELECT page, hash, n % 5 <> 1 AS fresh, substr(sha256('kb:' || n || ':' || status), 1, 24) AS seen_key FROM h WHERE status <> 'current' AND coalesce(flag, status IN ('stale', 'needs_review'))),
old AS (SELECT f.*, CAST(f.document_id AS BIGINT) AS n, CASE WHEN CAST(f.document_id AS BIGINT) % 5 = 0 THEN h.hash END AS old_hash FROM f LEFT JOIN h ON h.page = f.document_id),
j AS (SELECT coalesce(finding_key, seen_key) AS key, coalesce(document_id, page) AS doc, workflow_state AS state, snoozed_until, note, n, checked, old_hash, hash, fresh, seen_key IS NOT NULL AS is_seen,
  finding_key IS NOT NULL AS is_old, CAST(coalesce(document_id, page) AS BIGINT) % 11 <> 4 AS in_scan FROM old FULL JOIN seen ON finding_key = seen_key)"""


def _fourth_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    status = F.when(n % 8 == 5, "unknown").when(n % 4 == 0, "stale").when(n % 4 == 3, "current").otherwise("needs_review")
    text = n.cast("string")
    found = schema.details(age_days=n, matching_doc_ids=F.array(F.lit("b"), text))
    age = F.struct(F.lit("age").alias("signal_type"), F.lit("critical").alias("severity"), F.concat(text, F.lit(" days")).alias("message"), found.alias("details"))
    none = F.array().cast("array<string>")
    evidence = {
        "summary": F.concat(F.lit("sum "), status), "positive_evidence": none, "review_risks": F.array(F.lit("y"), F.lit("x")),
        "missing_evidence": F.when(n % 2 == 0, F.array(F.lit("m"))).otherwise(none), "recommended_action": F.lit("act"),
    }
    values = {
        "doc_ord": n, "document_id": text, "source_type": F.lit("kb"), "title": F.concat(F.lit("R"), n), "status": status,
        "signals": F.when(n % 3 == 0, F.array(age)).otherwise(F.array().cast(f"array<{schema.SIGNAL_TYPE}>")),
        "trust_metadata": F.struct(F.when(n % 10 == 5, True).when(n % 10 == 9, False).alias("requires_human_audit")),
        "trust_evidence": F.struct(*[v.alias(k) for k, v in evidence.items()]),
    }
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where(n % 11 != 4)
    return rows.select(*[v.alias(k) for k, v in values.items()])


@query(f"""WITH {_FINDING_SQL}, {_FOURTH_SQL},
c AS (SELECT *, CASE WHEN is_seen AND NOT is_old THEN 'new' WHEN is_seen AND (state = 'snoozed' AND coalesce(snoozed_until <= {_AS_OF_SQL}, false) OR state IN ('accepted_risk', 'dismissed', 'fixed') AND old_hash IS DISTINCT FROM hash) THEN 'reopened'
  WHEN is_seen THEN 'updated' WHEN in_scan AND state <> 'fixed' THEN 'auto_fixed' END AS change FROM j),
r AS (SELECT *, coalesce(change IN ('new', 'reopened') OR (change = 'updated' AND fresh), false) AS renewed FROM c)
SELECT key AS finding_key, doc AS document_id, CASE WHEN renewed THEN 'R' || doc ELSE 'T' || doc END AS title, CASE WHEN change IN ('new', 'reopened') THEN 'open' WHEN change = 'auto_fixed' THEN 'fixed' ELSE state END AS workflow_state,
  CASE WHEN change = 'auto_fixed' THEN 'No longer detected in scan #4' ELSE note END AS note, coalesce(change, '') <> 'reopened' AND snoozed_until IS NOT NULL AS has_snooze, CASE WHEN renewed THEN hash ELSE old_hash END AS evidence_hash,
  CASE WHEN is_old THEN n % 3 + 1 ELSE 4 END AS first_seen_scan_id, CASE WHEN renewed THEN 4 ELSE checked END AS last_seen_scan_id, CASE WHEN change IS NOT NULL OR in_scan THEN 4 ELSE checked END AS last_checked_scan_id, change FROM r""")
def workflow_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings after a fourth scan, some of whose pages were not looked at again; every fifth finding knows its evidence."""
    results = _fourth_scan(spark, sf_dir)
    fifth = F.col("document_id").cast("long") % 5
    known = results.where(fifth == 0).select("document_id", W.evidence_hash(F.col("status"), F.col("signals"), F.col("trust_evidence")).alias("evidence_hash"))
    findings = _findings(spark, sf_dir).drop("evidence_hash").join(known, "document_id", "left")
    merged = W.merge(findings, results, 4, AS_OF, reanalyzed=results.where(fifth != 1), scanned=results)
    kept = ("finding_key", "document_id", "title", "workflow_state", "note", "evidence_hash", "first_seen_scan_id", "last_seen_scan_id", "last_checked_scan_id", "change")
    return merged.select(*kept, F.col("snoozed_until").isNotNull().alias("has_snooze"))


@query(f"WITH {KB_SQL} SELECT id, content_hash FROM (SELECT id, sha256(content) AS content_hash, doc_ord FROM kb) WHERE doc_ord % 9 <> 4")
def unchanged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kb(spark, sf_dir)
    known = docs.select(F.col("id").alias("document_id"), F.sha2(F.when(F.col("doc_ord") % 9 == 4, "x").otherwise(F.col("content")), 256).alias("content_hash"))
    return H.split_unchanged(docs, known)[1].select("id", F.sha2("content", 256).alias("content_hash"))
