"""Registered queries: quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vouchsafe.functions.text import is_blank
from vouchsafe.operators import contracts as C
from vouchsafe.operators import gates as G
from vouchsafe.operators.embedding import HashingEmbedder, coverage, embed
from vouchsafe.operators.enrichment import enrich_table
from vouchsafe.operators.fingerprint import has_drifted, typed_schema_fingerprint, typed_schema_hash
from vouchsafe.plans import bindings as B
from vouchsafe.plans.registry import query
from vouchsafe.plans.validation_queries import drift_by_dataset
from vouchsafe.settings import GateThresholds

BARS = GateThresholds()

CONTRACT = C.Contract(required=("doc_id", "text"), constraints={"text": {"min_length": 10}})


def _checked(measured, check):
    return measured.select(F.inline(F.array(check)))


def _measured(df, required, key):
    return df.agg(*G.measures(C.field_reader(df), required, key))


@query(
    """SELECT CAST(0 AS INTEGER) AS ord, 'min_records' AS check_name, count(*) >= 1 AS passed,
  CAST(count(*) AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS threshold,
  '{"record_count":' || count(*) || '}' AS details FROM documents"""
)
def gate_min_records(spark, sf_dir):
    documents = B.table(spark, sf_dir, "documents")
    return _checked(_measured(documents, [], "doc_id"), G.min_records_check(BARS.min_records))


@query(
    f"""WITH {B.LABELLED_SQL}, m AS (
  SELECT count(nullif(text, '')) + count(quality) + count(toxic) AS filled, 3 * count(*) AS total
  FROM labelled)
SELECT CAST(1 AS INTEGER) AS ord, 'completeness' AS check_name, filled / total >= 0.95 AS passed,
  filled / total AS score, CAST(0.95 AS DOUBLE) AS threshold,
  '{{"filled_cells":' || filled || ',"total_cells":' || total || '}}' AS details FROM m"""
)
def gate_completeness(spark, sf_dir):
    labelled = B.labelled_documents(spark, sf_dir)
    measured = _measured(labelled, ["text", "quality", "toxic"], "doc_id")
    return _checked(measured, G.completeness_check(BARS.completeness))


@query(
    """WITH m AS (SELECT count(DISTINCT l_orderkey || '/' || l_linenumber) AS u, count(*) AS n FROM lineitem)
SELECT CAST(2 AS INTEGER) AS ord, 'uniqueness' AS check_name, u / n >= 0.99 AS passed, u / n AS score,
  CAST(0.99 AS DOUBLE) AS threshold, '{"unique_keys":' || u || ',"total_records":' || n
  || ',"records_missing_key":0}' AS details FROM m"""
)
def gate_uniqueness(spark, sf_dir):
    lineitem = B.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line")
    )
    return _checked(_measured(lineitem, [], "line"), G.uniqueness_check(BARS.uniqueness, "line"))


@query(
    f"""WITH {B.JSON_KEYS_SQL}, m AS (SELECT count(*) AS n, count(DISTINCT key) AS u FROM json_keys)
SELECT CAST(2 AS INTEGER) AS ord, 'uniqueness' AS check_name, u / n >= 0.99 AS passed, u / n AS score,
  CAST(0.99 AS DOUBLE) AS threshold,
  '{{"unique_keys":' || u || ',"total_records":' || n || ',"records_missing_key":0}}' AS details FROM m"""
)
def gate_json_uniqueness(spark, sf_dir):
    """Keys of several JSON types: numbers, numbers with a fraction, texts and booleans."""
    records = B.json_keyed(spark, sf_dir)
    measured = records.agg(*G.measures(C.field_reader(records, "rec"), [], "id"))
    return _checked(measured, G.uniqueness_check(BARS.uniqueness, "id"))


@query(
    """WITH m AS (SELECT avg(CASE WHEN length(text) >= 10 THEN 1.0 ELSE 0.0 END) AS rate FROM documents)
SELECT CAST(3 AS INTEGER) AS ord, 'validation_pass_rate' AS check_name, rate >= 0.95 AS passed,
  rate AS score, CAST(0.95 AS DOUBLE) AS threshold, '{}' AS details FROM m"""
)
def gate_pass_rate(spark, sf_dir):
    summary = C.validation_summary(C.validate(B.table(spark, sf_dir, "documents"), CONTRACT))
    return _checked(summary, G.pass_rate_check(BARS.validation_pass_rate, F.col("pass_rate")))


@query(
    f"""WITH {B.LABELLED_SQL}, m AS (
  SELECT avg(CASE WHEN coalesce(toxic, 0) <> 1 THEN 1.0 ELSE 0.0 END) AS coverage FROM labelled)
SELECT CAST(4 AS INTEGER) AS ord, 'embedding_coverage' AS check_name, coverage >= 0.98 AS passed,
  coverage AS score, CAST(0.98 AS DOUBLE) AS threshold, '{{}}' AS details FROM m"""
)
def gate_embedding_coverage(spark, sf_dir):
    shown = F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 1, F.col("text"))
    covered = B.labelled_documents(spark, sf_dir).agg(
        F.avg((~is_blank(shown)).cast("double")).alias("coverage")
    )
    return _checked(covered, G.coverage_check(BARS.embedding_coverage, F.col("coverage")))


_DRIFT_SQL = f"""WITH {B.VERSIONS_SQL},
baseline AS (
  SELECT dataset, arg_max(schema_hash, (updated_at, version_id)) AS previous FROM versions
  WHERE status = 'promoted' GROUP BY 1),
newest AS (SELECT dataset, arg_max(schema_hash, version_id) AS current FROM versions GROUP BY 1)
SELECT dataset, CAST(5 AS INTEGER) AS ord, 'schema_drift' AS check_name,
  NOT coalesce(previous <> current, false) AS passed,
  CASE WHEN coalesce(previous <> current, false) THEN 0.0 ELSE 1.0 END::DOUBLE AS score,
  CAST(1 AS DOUBLE) AS threshold, '{{}}' AS details
FROM newest LEFT JOIN baseline USING (dataset)"""


@query(_DRIFT_SQL)
def gate_schema_drift(spark, sf_dir):
    return drift_by_dataset(spark, sf_dir).select(
        "dataset", F.inline(F.array(G.drift_check(F.col("drifted"))))
    )


def document_checks(spark, sf_dir):
    """All six gates on the valid documents, from one pass over the table.

    Texts must be unique, and in the state before this one n_chars was a text.
    """
    documents = B.table(spark, sf_dir, "documents")
    earlier = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name == "n_chars" else f for f in documents.schema]
    )
    judged = C.validate(documents, CONTRACT)
    valid = C.is_valid()
    read = C.field_reader(documents)
    measured = judged.agg(
        *G.measures(read, list(CONTRACT.required), "text", valid),
        C.pass_rate().alias("pass_rate"),
        F.coalesce(
            F.avg(F.when(valid, (~is_blank(F.col("text"))).cast("double"))), F.lit(0.0)
        ).alias("coverage"),
        has_drifted(typed_schema_hash(earlier), typed_schema_hash(documents.schema)).alias("drifted"),
    )
    inputs = G.GateInputs(F.col("pass_rate"), F.col("coverage"), F.col("drifted"))
    return G.gate_suite(measured, inputs, "text", BARS)


_SUITE_SQL = """m AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE length(text) >= 10) AS n,
         count(DISTINCT text) FILTER (WHERE length(text) >= 10) AS u,
         bool_or(n_chars IS NOT NULL) AS counted,
         count(*) FILTER (WHERE length(text) >= 10 AND trim(text) <> '') AS filled_text
  FROM documents),
checks AS (
  SELECT CAST(0 AS INTEGER) AS ord, 'min_records' AS check_name, n >= 1 AS passed,
         CAST(n AS DOUBLE) AS score, CAST(1 AS DOUBLE) AS threshold,
         '{"record_count":' || n || '}' AS details FROM m
  UNION ALL SELECT 1, 'completeness', true, 1.0, 0.95,
         '{"filled_cells":' || 2 * n || ',"total_cells":' || 2 * n || '}' FROM m
  UNION ALL SELECT 2, 'uniqueness', u / n >= 0.99, u / n, 0.99, '{"unique_keys":' || u
         || ',"total_records":' || n || ',"records_missing_key":0}' FROM m
  UNION ALL SELECT 3, 'validation_pass_rate', n / total >= 0.95, n / total, 0.95, '{}' FROM m
  UNION ALL SELECT 4, 'embedding_coverage', filled_text / n >= 0.98, filled_text / n, 0.98, '{}' FROM m
  UNION ALL SELECT 5, 'schema_drift', NOT counted, CASE WHEN counted THEN 0.0 ELSE 1.0 END, 1.0, '{}'
  FROM m)"""


@query(f"WITH {_SUITE_SQL} SELECT * FROM checks")
def gate_suite(spark, sf_dir):
    return document_checks(spark, sf_dir)


@query(
    f"""WITH {_SUITE_SQL}
SELECT bool_and(passed) AS passed, count(*) AS total_checks,
  coalesce(string_agg(check_name, ', ' ORDER BY ord) FILTER (WHERE NOT passed), '') AS failed_checks
FROM checks"""
)
def gate_verdict(spark, sf_dir):
    return G.verdict(document_checks(spark, sf_dir)).select(
        "passed", "total_checks", F.concat_ws(", ", "failed_checks").alias("failed_checks")
    )


# Bars of the generic gate; one has no score anywhere.
_BARS = {"A": 0.94, "N": 0.95, "R": 0.93}


@query(
    f"""WITH {B.REPORTS_SQL},
bars AS (SELECT * FROM (VALUES ('A', 0.94), ('N', 0.95), ('R', 0.93)) t(name, bar)),
judged AS (
  SELECT v.version_id, b.name, coalesce(r.score >= b.bar, false) AS ok
  FROM (SELECT 'v' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS version_id FROM customer) v, bars b
  LEFT JOIN reports r ON r.version_id = v.version_id AND r.check_name = b.name)
SELECT version_id, bool_and(ok) AS passed, count(*) AS total_checks,
  coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE NOT ok), '') AS failed_checks,
  CASE WHEN bool_and(ok) THEN 'promoted' ELSE 'rejected' END AS decision
FROM judged GROUP BY 1"""
)
def threshold_gate(spark, sf_dir):
    """Every version against three bars; versions without scores are refused."""
    scores = B.reports(spark, sf_dir).select(
        "version_id", F.col("check_name").alias("name"), "score"
    )
    bars = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(b).alias("threshold")) for n, b in _BARS.items()]
    )
    thresholds = B.version_names(spark, sf_dir).select("version_id", F.inline(bars))
    return G.threshold_gate(scores, thresholds, ["version_id"]).withColumn(
        "failed_checks", F.concat_ws(", ", "failed_checks")
    )


# ---------------------------------------------------------------- a whole life

_TRACE_SQL = """WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
  FROM documents WHERE length(text) >= 10),
n AS (
  SELECT (SELECT count(*) FROM documents) AS raw, (SELECT count(*) FROM ranked) AS valid,
         (SELECT count(*) FROM ranked WHERE rn = 1) AS kept,
         (SELECT avg(CASE WHEN trim(text) <> '' THEN 1.0 ELSE 0.0 END) FROM ranked WHERE rn = 1) AS covered,
         (SELECT bool_or(n_chars IS NOT NULL) IS DISTINCT FROM
                 bool_or(n_chars IS NOT NULL) FILTER (WHERE source <> 'src0')
          OR bool_or(lang IS NOT NULL) IS DISTINCT FROM
                 bool_or(lang IS NOT NULL) FILTER (WHERE source <> 'src0') FROM documents) AS blank)
SELECT 'ingest' AS stage, 'raw_records' AS metric, CAST(raw AS DOUBLE) AS value FROM n
UNION ALL SELECT 'validate', 'valid', valid FROM n
UNION ALL SELECT 'validate', 'quarantined', raw - valid FROM n
UNION ALL SELECT 'validate', 'pass_rate', round(valid / raw, 4) FROM n
UNION ALL SELECT 'enrich', 'output_records', kept FROM n
UNION ALL SELECT 'enrich', 'duplicates_removed', valid - kept FROM n
UNION ALL SELECT 'validate', 'drifted', CASE WHEN blank THEN 1.0 ELSE 0.0 END FROM n
UNION ALL SELECT 'embed', 'coverage', covered FROM n
UNION ALL SELECT 'gate', 'passed', CASE WHEN valid / raw >= 0.95 AND NOT blank THEN 1.0 ELSE 0.0 END FROM n
UNION ALL SELECT 'promote', 'promoted', CASE WHEN valid / raw >= 0.95 AND NOT blank THEN 1.0 ELSE 0.0 END
FROM n"""


@query(_TRACE_SQL)
def lifecycle_trace(spark, sf_dir):
    """The stages of a version made of all documents, as metrics; equal texts are duplicates."""
    documents = B.documents(spark, sf_dir).withColumn("id", F.sha2("text", 256))
    judged = C.validate(documents, CONTRACT)
    enriched = enrich_table(
        C.valid_records(judged), "v1", F.lit("2024-01-01").cast("timestamp"), "id", ["doc_id"]
    )
    embedded = embed(enriched, HashingEmbedder())
    # The earlier state of the table lacked one source.
    now, earlier = documents, documents.where("source <> 'src0'")
    drifted = has_drifted(typed_schema_fingerprint(earlier).scalar(), typed_schema_fingerprint(now).scalar())
    summary = C.validation_summary(judged)
    before = summary.select(F.struct(*summary.columns)).scalar()
    measured = embedded.agg(
        *G.measures(C.field_reader(embedded), list(CONTRACT.required), "id"),
        coverage().alias("coverage"),
    ).withColumn("before", before).select("*", "before.*").withColumn("drifted", drifted)
    inputs = G.GateInputs(F.col("pass_rate"), F.col("coverage"), F.col("drifted"))
    checks = F.array(*G.gate_checks(inputs, "id", BARS))
    passed = F.forall(checks, lambda c: c["passed"])
    rows = (
        ("ingest", "raw_records", F.col("total")),
        ("validate", "valid", F.col("valid")),
        ("validate", "quarantined", F.col("quarantined")),
        ("validate", "pass_rate", F.round("pass_rate", 4)),
        ("validate", "drifted", F.col("drifted").cast("int")),
        ("enrich", "output_records", F.col("rows")),
        ("enrich", "duplicates_removed", F.col("valid") - F.col("rows")),
        ("embed", "coverage", F.col("coverage")),
        ("gate", "passed", passed.cast("int")),
        ("promote", "promoted", passed.cast("int")),
    )
    return measured.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(stage).alias("stage"), F.lit(name).alias("metric"),
                        value.cast("double").alias("value"),
                    )
                    for stage, name, value in rows
                ]
            )
        )
    )
