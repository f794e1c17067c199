"""Registered queries: sources, contracts, fingerprints, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchsafe.functions import hashing, identifiers
from vouchsafe.functions import text as X
from vouchsafe.operators import contracts as C
from vouchsafe.operators import enrichment as E
from vouchsafe.operators import fingerprint as P
from vouchsafe.operators import ledger as L
from vouchsafe.plans import bindings as B
from vouchsafe.plans.registry import query
from vouchsafe.session import spread
from vouchsafe.sources import json_records as J
from vouchsafe.sources import manifest as M

DOCUMENT_CONTRACT = C.Contract(
    required=("doc_id", "text"),
    types={"doc_id": "int", "text": "str", "lang": "str"},
    constraints={
        "text": {"min_length": 200},
        "n_chars": {"max": 20000},
        "lang": {"allowed": ["en", "fr", "de"]},
    },
)

_REASONS_SQL = """judged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN doc_id IS NULL THEN 'missing required field ''doc_id''' END,
    CASE WHEN text IS NULL OR text = '' THEN 'missing required field ''text''' END,
    CASE WHEN length(text) < 200 THEN 'field ''text'' shorter than 200' END,
    CASE WHEN n_chars > 20000 THEN 'field ''n_chars'' above max 20000' END,
    CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'field ''lang'' not in allowed set' END) AS reason
  FROM documents)"""


def _judged_documents(spark, sf_dir):
    return C.validate(B.documents(spark, sf_dir), DOCUMENT_CONTRACT)


def _reason_rows(df, contract, key, record=None):
    judged = C.validate(df, contract, record)
    return judged.select(key, F.explode(C.REASONS).alias("reason"))


# ---------------------------------------------------------------- sources


@query(
    f"""WITH {B.PAYLOADS_SQL}
SELECT o_orderkey, 0 AS pos, CASE WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS priority,
       CAST(o_orderkey AS VARCHAR) AS record_id,
       CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_custkey AS VARCHAR) END AS customer,
       CAST(NULL AS VARCHAR) AS error
FROM payloads WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
UNION ALL
SELECT o_orderkey, 1, NULL, NULL, CAST(o_custkey AS VARCHAR), NULL
FROM payloads WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM')
UNION ALL
SELECT o_orderkey, NULL, NULL, NULL, NULL, CASE o_orderpriority
  WHEN '4-NOT SPECIFIED' THEN 'invalid JSON on line 2'
  ELSE 'top-level JSON must be an object or array' END
FROM payloads WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')"""
)
def ingest_json_records(spark, sf_dir):
    parsed = J.parse_payloads(B.payloads(spark, sf_dir))
    return parsed.select("o_orderkey", "error", F.posexplode_outer("records").alias("pos", "rec")).select(
        "o_orderkey",
        "pos",
        F.try_variant_get("rec", "$.priority", "string").alias("priority"),
        F.try_variant_get("rec", "$.id", "string").alias("record_id"),
        F.try_variant_get("rec", "$.customer", "string").alias("customer"),
        "error",
    )


@query(
    f"""WITH {B.PAYLOADS_SQL}, judged AS (
  SELECT *, octet_length(encode(content)) AS size, substr(sha256(content), 1, 12) AS content_hash,
    CASE WHEN NOT regexp_full_match(dataset, '[a-z0-9_-]{{1,64}}') THEN 'invalid dataset'
         WHEN NOT regexp_matches(file_name, '\\.jsonl?$') THEN 'only .json / .jsonl files are accepted'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'invalid JSON payload: invalid JSON on line 2'
         WHEN o_orderpriority = '5-LOW'
           THEN 'invalid JSON payload: top-level JSON must be an object or array' END AS reject_reason
  FROM payloads)
SELECT o_orderkey, dataset, size, content_hash,
       content_hash || '-' || regexp_replace(substr(file_name, 4), '[^a-zA-Z0-9._-]', '_', 'g') AS object_key,
       reject_reason, reject_reason IS NULL AS accepted,
       CASE WHEN reject_reason IS NULL THEN CASE o_orderpriority WHEN '2-HIGH' THEN CAST(1 AS BIGINT)
            ELSE CAST(2 AS BIGINT) END END AS record_count
FROM judged"""
)
def ingest_manifest(spark, sf_dir):
    uploads = B.payloads(spark, sf_dir).withColumn("content", F.encode("content", "UTF-8"))
    return M.landing_manifest(uploads).drop("file_name")


@query(
    f"""WITH {B.ENVELOPES_SQL}, judged AS (
  SELECT *, CASE WHEN dataset = 'Pending orders' THEN 'invalid dataset'
       WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'no records'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'records must be objects' END AS error
  FROM envelopes)
SELECT o_orderkey, dataset, pipeline, error,
       CASE WHEN error IS NULL THEN CAST(CASE o_orderpriority WHEN '2-HIGH' THEN 1 ELSE 2 END AS BIGINT)
            END AS record_count,
       CASE WHEN error IS NULL THEN substr(sha256(records), 1, 12) END AS content_hash
FROM judged"""
)
def webhook_envelopes(spark, sf_dir):
    return J.parse_envelopes(B.envelopes(spark, sf_dir)).drop("body", "records")


@query(
    """SELECT url, regexp_full_match(url_host, '[a-z0-9_-]{1,64}') AS is_identifier, url_host
FROM (SELECT url, split_part(split_part(url, '/', 3), '.', 1) AS url_host FROM pages)"""
)
def identifier_filter(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1))
    return B.table(spark, sf_dir, "pages").select("url", host.alias("url_host")).withColumn(
        "is_identifier", identifiers.is_identifier(F.col("url_host"))
    )


@query(
    """SELECT page_id, substr(CASE WHEN cleaned = '' THEN 'upload' ELSE cleaned END, 1, 128) AS object_key
FROM (SELECT page_id, ltrim(regexp_replace(split_part(replace(url, chr(92), '/'), '/', -1),
        '[^a-zA-Z0-9._-]', '_', 'g'), '.') AS cleaned FROM pages)"""
)
def safe_object_key(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select(
        "page_id", identifiers.safe_object_key(F.col("url")).alias("object_key")
    )


@query(
    """SELECT o_orderpriority, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1"""
)
def latest_per_group(spark, sf_dir):
    return M.latest_per_group(
        B.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_orderdate"
    )


@query(
    f"""WITH {B.VERSIONS_SQL}
SELECT version_id, dataset FROM names WHERE NOT balance >= 0"""
)
def register_versions_anti_join(spark, sf_dir):
    names = B.version_names(spark, sf_dir)
    return L.register_versions(names.where("balance >= 0"), names).select("version_id", "dataset")


# ---------------------------------------------------------------- contracts


@query(
    f"""WITH {B.LABELLED_SQL}
SELECT doc_id, 'missing required field ''quality''' AS reason FROM labelled WHERE quality IS NULL"""
)
def validate_required(spark, sf_dir):
    return _reason_rows(
        B.labelled_documents(spark, sf_dir), C.Contract(required=("doc_id", "quality")), "doc_id"
    )


@query(
    """SELECT event_id, 'field ''v'' expected number, got '
  || CASE event_type WHEN 'error' THEN 'str' WHEN 'view' THEN 'list' ELSE 'dict' END AS reason
FROM events WHERE event_type IN ('error', 'view', 'signup')"""
)
def validate_types(spark, sf_dir):
    value = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"')))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), F.col("value").cast("string"), F.lit("]")))
        .when(F.col("event_type") == "signup", F.col("props"))
        .when(F.col("event_type") == "click", F.lit("true"))
        .otherwise(F.col("value").cast("string"))
    )
    events = B.table(spark, sf_dir, "events").select(
        "event_id", F.parse_json(F.concat(F.lit('{"v": '), value, F.lit("}"))).alias("rec")
    )
    return _reason_rows(events, C.Contract(types={"v": "number"}), "event_id", record="rec")


@query(
    """SELECT c_custkey, 'field ''c_acctbal'' below min 0' AS reason FROM customer WHERE c_acctbal < 0
UNION ALL
SELECT c_custkey, 'field ''c_acctbal'' above max 9000' FROM customer WHERE c_acctbal > 9000"""
)
def validate_range(spark, sf_dir):
    contract = C.Contract(constraints={"c_acctbal": {"min": 0, "max": 9000}})
    return _reason_rows(B.table(spark, sf_dir, "customer"), contract, "c_custkey")


@query(
    """SELECT doc_id, 'field ''text'' shorter than 10' AS reason FROM documents WHERE length(text) < 10"""
)
def validate_min_length(spark, sf_dir):
    contract = C.Contract(constraints={"text": {"min_length": 10}})
    return _reason_rows(B.table(spark, sf_dir, "documents"), contract, "doc_id")


@query(
    """SELECT c_custkey, 'field ''c_mktsegment'' not in allowed set' AS reason FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')"""
)
def validate_allowed(spark, sf_dir):
    contract = C.Contract(
        constraints={"c_mktsegment": {"allowed": ["BUILDING", "AUTOMOBILE", "MACHINERY"]}}
    )
    return _reason_rows(B.table(spark, sf_dir, "customer"), contract, "c_custkey")


@query(f"WITH {_REASONS_SQL} SELECT doc_id, reason, reason = '' AS valid FROM judged")
def validate_split(spark, sf_dir):
    return _judged_documents(spark, sf_dir).select(
        "doc_id", F.concat_ws("; ", C.REASONS).alias("reason"), C.is_valid().alias("valid")
    )


@query(
    f"""WITH {_REASONS_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE reason = '') AS valid,
       count(*) FILTER (WHERE reason <> '') AS quarantined,
       coalesce(avg(CASE WHEN reason = '' THEN 1.0 ELSE 0.0 END), 0.0) AS pass_rate
FROM judged"""
)
def validation_pass_rate(spark, sf_dir):
    return C.validation_summary(_judged_documents(spark, sf_dir))


@query(
    f"""WITH {_REASONS_SQL}
SELECT lang AS version_id, CAST(doc_id AS VARCHAR) AS record_key, reason, text AS payload
FROM judged WHERE reason <> ''"""
)
def quarantine_rows(spark, sf_dir):
    return C.quarantine_rows(
        _judged_documents(spark, sf_dir), F.col("lang"), F.col("doc_id"), F.col("text")
    )


@query(
    f"""WITH {_REASONS_SQL}
SELECT part AS reason, count(*) AS records
FROM (SELECT unnest(string_split(reason, '; ')) AS part FROM judged WHERE reason <> '') GROUP BY 1"""
)
def quarantine_reasons(spark, sf_dir):
    return C.reason_counts(_judged_documents(spark, sf_dir))


@query(
    f"""WITH {_REASONS_SQL}
SELECT doc_id, reason, doc_id AS id FROM judged WHERE reason <> '' ORDER BY doc_id LIMIT 6"""
)
def quarantine_samples(spark, sf_dir):
    return C.quarantine_samples(_judged_documents(spark, sf_dir), ["doc_id"], F.col("doc_id"))


# ---------------------------------------------------------------- fingerprints


@query(
    f"""WITH {B.LABELLED_SQL},
first_record AS (SELECT * FROM labelled ORDER BY doc_id LIMIT 1)
SELECT substr(sha256('{{"doc_id": "int", "lang": "str", "n_chars": "int", "quality": "'
  || CASE WHEN quality IS NULL THEN 'NoneType' ELSE 'int' END
  || '", "source": "str", "text": "str", "toxic": "'
  || CASE WHEN toxic IS NULL THEN 'NoneType' ELSE 'int' END || '"}}'), 1, 16) AS schema_hash
FROM first_record"""
)
def schema_fingerprint(spark, sf_dir):
    records = B.labelled_documents(spark, sf_dir).select(
        "doc_id",
        F.to_variant_object(
            F.struct("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
        ).alias("rec"),
    )
    return P.schema_fingerprint(records, ["doc_id"], "rec")


_BASELINE_SQL = """baseline AS (
  SELECT dataset, schema_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY updated_at DESC, version_id DESC) AS rn
    FROM versions WHERE status = 'promoted') WHERE rn = 1),
newest AS (
  SELECT dataset, schema_hash FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY version_id DESC) AS rn FROM versions)
  WHERE rn = 1)"""


@query(f"WITH {B.VERSIONS_SQL}, {_BASELINE_SQL} SELECT dataset, schema_hash FROM baseline")
def last_promoted_hash(spark, sf_dir):
    return P.last_promoted_hash(B.versions(spark, sf_dir))


def drift_by_dataset(spark, sf_dir):
    versions = B.versions(spark, sf_dir)
    newest = versions.groupBy("dataset").agg(
        F.max_by("schema_hash", "version_id").alias("current_hash")
    )
    baseline = P.last_promoted_hash(versions).withColumnRenamed("schema_hash", "previous_hash")
    return P.detect_drift(newest.join(baseline, "dataset", "left"))


@query(
    f"""WITH {B.VERSIONS_SQL}, {_BASELINE_SQL}
SELECT n.dataset, n.schema_hash AS current_hash, b.schema_hash AS previous_hash,
  coalesce(b.schema_hash <> n.schema_hash, false) AS drifted,
  CASE WHEN b.schema_hash IS NULL THEN 'no previous version (first ingest)'
       WHEN b.schema_hash <> n.schema_hash THEN 'schema fingerprint changed'
       ELSE 'schema stable' END AS reason
FROM newest n LEFT JOIN baseline b USING (dataset)"""
)
def detect_drift(spark, sf_dir):
    return drift_by_dataset(spark, sf_dir)


# ---------------------------------------------------------------- enrichment

_NORMAL_SQL = (
    "trim(regexp_replace(nfc_normalize(text), "
    "'[\\s\\x0B\\p{Z}\\x{0085}\\x{001C}-\\x{001F}]+', ' ', 'g'))"
)


@query(f"SELECT doc_id, {_NORMAL_SQL} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return B.documents(spark, sf_dir).select(
        "doc_id", X.normalize(F.col("text")).alias("text")
    )


@query(
    """SELECT doc_id, lang FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""
)
def dedup_keep_first(spark, sf_dir):
    keyed = B.documents(spark, sf_dir).select("doc_id", "lang", F.sha2("text", 256).alias("key"))
    return E.keep_first(keyed, ["key"], ["doc_id"]).drop("key")


@query(
    """SELECT CAST(sum(copies) AS BIGINT) AS input_records, count(*) AS output_records,
       CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed
FROM (SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2)"""
)
def dedup_report(spark, sf_dir):
    return E.dedup_counts(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_HASH_SQL = """substr(sha256(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars,
  'source': source, 'text': text})), 1, 16)"""


@query(f"SELECT doc_id, {_HASH_SQL} AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    documents = B.documents(spark, sf_dir)
    return documents.select("doc_id", hashing.content_hash(documents.columns).alias("content_hash"))


@query(
    f"""WITH {B.JSON_KEYS_SQL} SELECT key, min(o_orderkey) AS o_orderkey FROM json_keys GROUP BY 1"""
)
def dedup_json_keep_first(spark, sf_dir):
    """The first record of each JSON key; keys of different types stay apart."""
    records = B.json_keyed(spark, sf_dir)
    key = C.field_reader(records, "rec")("id").as_string
    keyed = records.select("o_orderkey", E.dedup_key(key, F.lit("")).alias("key"))
    return E.keep_first(keyed, ["key"], ["o_orderkey"])


_SEARCH_SQL = f"concat_ws(' | ', nullif(source, ''), nullif({_NORMAL_SQL}, ''))"


@query(f"SELECT doc_id, {_SEARCH_SQL} AS search_text FROM documents")
def search_text(spark, sf_dir):
    documents = B.documents(spark, sf_dir).withColumn("text", X.normalize(F.col("text")))
    return documents.select(
        "doc_id", X.search_text([F.col("source"), F.col("text")]).alias("search_text")
    )


@query(
    f"""SELECT doc_id, 'v1' AS version_id, {_HASH_SQL} AS content_hash,
  length(coalesce({_NORMAL_SQL}, '')) AS text_length, CAST(5 AS BIGINT) AS field_count
FROM documents"""
)
def lineage_meta(spark, sf_dir):
    documents = B.documents(spark, sf_dir)
    enriched = E.enrich_table(
        documents, "v1", F.lit("2024-01-01").cast("timestamp"), "doc_id", ["doc_id"]
    )
    return enriched.select("doc_id", "_meta.*").drop("enriched_at")


@query(
    f"""WITH {B.LABELLED_SQL}, n AS (SELECT count(*) AS n,
  count(doc_id) AS doc_id, count(nullif(text, '')) AS text, count(nullif(lang, '')) AS lang,
  count(nullif(source, '')) AS source, count(n_chars) AS n_chars, count(quality) AS quality,
  count(toxic) AS toxic FROM labelled)
SELECT field, round(filled / n, 3) AS fill_rate
FROM (UNPIVOT n ON doc_id, text, lang, source, n_chars, quality, toxic INTO NAME field VALUE filled)
WHERE filled > 0"""
)
def profile_fill_rates(spark, sf_dir):
    return E.fill_rates(B.labelled_documents(spark, sf_dir))


@query(
    """WITH e AS (SELECT event_type, props FROM events)
SELECT field, round(filled / n, 3) AS fill_rate FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS a,
         count(*) FILTER (WHERE event_type = 'view') AS b, count(*) AS c FROM e)
UNPIVOT (filled FOR field IN (a, b, c)) WHERE filled > 0"""
)
def profile_json_fill_rates(spark, sf_dir):
    """The same profile over JSON records: one field is sometimes null, one sometimes empty."""
    a = F.when(F.col("event_type") == "click", "1").otherwise("null")
    b = F.when(F.col("event_type") == "view", '"x"').when(F.col("event_type") == "error", "[]")
    record = F.concat(
        F.lit('{"a": '), a, F.lit(', "b": '), F.coalesce(b, F.lit('""')), F.lit(', "c": '),
        F.col("props"), F.lit("}"),
    )
    events = spread(B.table(spark, sf_dir, "events")).select(F.parse_json(record).alias("rec"))
    return E.variant_fill_rates(events)
