"""How the registered queries read the given tables as records, versions, ledgers and events.

Each binding exists as a DataFrame and as the SQL text of the same relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchsafe.session import prepare, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread out for work on their texts."""
    return spread(table(spark, sf_dir, "documents"))


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


# Reports are made as of a fixed time; the data ends there.
LEDGER_AS_OF = "2001-08-01 00:00:00"
REPORTS_AS_OF = "2001-11-04 00:00:00"
EVENTS_AS_OF = "2024-01-30 00:00:00"


def version_name(number: str) -> Column:
    return F.concat(F.lit("v"), F.lpad(F.col(number).cast("string"), 9, "0"))


def _mapped(column: str, values: dict[str, str]) -> Column:
    expr = None
    for value, name in values.items():
        test = F.col(column) == value
        expr = F.when(test, name) if expr is None else expr.when(test, name)
    return expr


def _case(column: str, values: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{value}' THEN '{name}'" for value, name in values.items())
    return f"CASE {column} {arms} END"


STATUS_OF_PRIORITY = {
    "1-URGENT": "promoted",
    "2-HIGH": "rejected",
    "3-MEDIUM": "validated",
    "4-NOT SPECIFIED": "gated",
    "5-LOW": "rolled_back",
}
DECISION_OF_STATUS = {"F": "promoted", "O": "rejected", "P": "rolled_back"}


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a status change of its customer's version; finished ones carry a count."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        version_name("o_custkey").alias("version_id"),
        _mapped("o_orderpriority", STATUS_OF_PRIORITY).alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).alias("record_count"),
        F.col("o_orderdate").alias("at"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a version of the dataset its market segment names."""
    place = F.struct("at", "seq")
    history = transitions(spark, sf_dir).groupBy("version_id").agg(
        F.max_by("status", place).alias("status"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_mktsegment").alias("dataset"),
            version_name("c_custkey").alias("version_id"),
            F.col("c_nationkey").cast("string").alias("schema_hash"),
            F.col("c_acctbal").alias("balance"),
        )
        .join(history, "version_id", "left")
    )


def version_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("dataset"),
        version_name("c_custkey").alias("version_id"),
        F.col("c_nationkey").cast("string").alias("schema_hash"),
        F.col("c_acctbal").alias("balance"),
    )


def live_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with a negative balance have lost their collection."""
    return version_names(spark, sf_dir).where("balance >= 0").select("dataset", "version_id")


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        version_name("o_custkey").alias("version_id"),
        _mapped("o_orderstatus", DECISION_OF_STATUS).alias("decision"),
        F.col("o_orderdate").alias("decided_at"),
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with the dataset of their version."""
    names = version_names(spark, sf_dir).select("version_id", "dataset")
    return ledger_rows(spark, sf_dir).join(names, "version_id")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's average discount per return flag is a check of the version of that number."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(version_name("l_suppkey").alias("version_id"), F.col("l_returnflag").alias("check_name"))
        .agg(
            # Discounts are whole percents; summed as integers they do not depend on order.
            (1 - F.sum(F.round(F.col("l_discount") * 100).cast("bigint"))
             / (F.count(F.lit(1)) * 100)).alias("score"),
            F.max("l_shipdate").alias("created_at"),
        )
        .withColumn("threshold", F.lit(0.95))
        .withColumn("passed", F.col("score") >= F.col("threshold"))
    )


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(
            version_name("l_suppkey").alias("version_id"),
            F.col("l_orderkey").cast("string").alias("record_key"),
            F.col("l_linestatus").alias("reason"),
            F.col("l_shipdate").alias("created_at"),
        )
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, which most lack."""
    labels = table(spark, sf_dir, "labels")
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


PAYLOAD_DATASETS = {"F": "finished", "O": "open", "P": "Pending orders"}


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a raw upload; its priority decides the shape of the text."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    priority = F.col("o_orderpriority")
    one = F.concat(F.lit('{"id": '), key, F.lit(', "priority": "'), priority, F.lit('"}'))
    two = F.concat(F.lit('{"customer": "'), customer, F.lit('"}'))
    pretty = F.concat(F.lit('{\n  "id": '), key, F.lit(',\n  "customer": "'), customer, F.lit('"\n}\n'))
    content = (
        F.when(priority == "1-URGENT", F.concat(F.lit("["), one, F.lit(", "), two, F.lit("]")))
        .when(priority == "2-HIGH", pretty)
        .when(priority == "3-MEDIUM", F.concat(one, F.lit("\n\n"), two, F.lit("\n")))
        .when(priority == "4-NOT SPECIFIED", F.concat(one, F.lit("\n{bad "), key, F.lit("}")))
        .otherwise(key)
    )
    suffix = F.when(F.col("o_totalprice") < 50000, ".csv").when(
        priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), ".jsonl"
    ).otherwise(".json")
    return spread(table(spark, sf_dir, "orders")).select(
        F.col("o_orderkey"),
        _mapped("o_orderstatus", PAYLOAD_DATASETS).alias("dataset"),
        F.concat(F.lit("in/"), priority, F.lit("#"), key, suffix).alias("file_name"),
        content.alias("content"),
    )


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a webhook body; its priority decides the records it carries."""
    key = F.col("o_orderkey").cast("string")
    priority = F.col("o_orderpriority")
    records = (
        F.when(priority == "1-URGENT", F.concat(F.lit('[{"b": "x", "id": '), key, F.lit('}, {"a": null}]')))
        .when(priority == "2-HIGH", F.concat(F.lit('[{"id": '), key, F.lit("}]")))
        .when(priority == "3-MEDIUM", F.lit("[]"))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("["), key, F.lit("]")))
        .otherwise(F.lit("null"))
    )
    pipeline = F.when(F.col("o_totalprice") < 50000, ', "pipeline": "bulk"').otherwise("")
    return spread(table(spark, sf_dir, "orders")).select(
        "o_orderkey",
        F.concat(
            F.lit('{"dataset": "'), _mapped("o_orderstatus", PAYLOAD_DATASETS),
            F.lit('", "records": '), records, pipeline, F.lit("}"),
        ).alias("body"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one type are attempts to deliver one message; small values succeed."""
    return table(spark, sf_dir, "events").withColumn("ok", F.col("value") < 35)


MESSAGE = ["user_id", "event_type"]


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewed and clicked events were handed over when they happened."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("view", "click"))
        .select("event_id", F.col("ts").alias("marked_at"))
    )


# The same relations in SQL.

_VERSION = "'v' || lpad(CAST({} AS VARCHAR), 9, '0')"

TRANSITIONS_SQL = f"""transitions AS (
  SELECT o_orderkey AS seq, {_VERSION.format('o_custkey')} AS version_id,
         {_case('o_orderpriority', STATUS_OF_PRIORITY)} AS status,
         CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END AS record_count,
         o_orderdate AS moved_at
  FROM orders)"""

VERSIONS_SQL = f"""{TRANSITIONS_SQL},
names AS (
  SELECT c_mktsegment AS dataset, {_VERSION.format('c_custkey')} AS version_id,
         CAST(c_nationkey AS VARCHAR) AS schema_hash, c_acctbal AS balance
  FROM customer),
last_state AS (
  SELECT version_id, status FROM (
    SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY moved_at DESC, seq DESC) AS rn
    FROM transitions) WHERE rn = 1),
span AS (
  SELECT version_id, min(moved_at) AS created_at, max(moved_at) AS updated_at FROM transitions GROUP BY 1),
versions AS (
  SELECT n.*, l.status, s.created_at, s.updated_at
  FROM names n LEFT JOIN last_state l USING (version_id) LEFT JOIN span s USING (version_id))"""

LEDGER_SQL = f"""ledger AS (
  SELECT o_orderkey AS id, {_VERSION.format('o_custkey')} AS version_id,
         {_case('o_orderstatus', DECISION_OF_STATUS)} AS decision, o_orderdate AS decided_at
  FROM orders)"""

PROMOTIONS_SQL = f"""{VERSIONS_SQL},
{LEDGER_SQL},
promotions AS (
  SELECT l.*, n.dataset FROM ledger l JOIN names n USING (version_id)),
serving AS (
  SELECT dataset, version_id, id FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id DESC) AS rn
    FROM promotions WHERE decision IN ('promoted', 'rolled_back')) WHERE rn = 1),
history AS (
  SELECT dataset, version_id, max(id) AS ledger_id,
         row_number() OVER (PARTITION BY dataset ORDER BY max(id) DESC) AS position
  FROM promotions WHERE decision = 'promoted' GROUP BY dataset, version_id),
live AS (SELECT dataset, version_id FROM names WHERE balance >= 0)"""

REPORTS_SQL = f"""reports AS (
  SELECT *, score >= threshold AS passed FROM (
    SELECT {_VERSION.format('l_suppkey')} AS version_id, l_returnflag AS check_name,
           1 - CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / (count(*) * 100) AS score, max(l_shipdate) AS created_at,
           CAST(0.95 AS DOUBLE) AS threshold
    FROM lineitem GROUP BY 1, 2))"""

QUARANTINE_SQL = f"""quarantine AS (
  SELECT {_VERSION.format('l_suppkey')} AS version_id, CAST(l_orderkey AS VARCHAR) AS record_key,
         l_linestatus AS reason, l_shipdate AS created_at
  FROM lineitem WHERE l_returnflag = 'R')"""

PAYLOADS_SQL = f"""payloads AS (
  SELECT o_orderkey, o_orderpriority, o_custkey,
    {_case('o_orderstatus', PAYLOAD_DATASETS)} AS dataset,
    'in/' || o_orderpriority || '#' || o_orderkey || CASE
      WHEN o_totalprice < 50000 THEN '.csv'
      WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN '.jsonl' ELSE '.json' END AS file_name,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN '[' || one || ', ' || two || ']'
      WHEN '2-HIGH' THEN '{{' || chr(10) || '  "id": ' || o_orderkey || ',' || chr(10)
                         || '  "customer": "' || o_custkey || '"' || chr(10) || '}}' || chr(10)
      WHEN '3-MEDIUM' THEN one || chr(10) || chr(10) || two || chr(10)
      WHEN '4-NOT SPECIFIED' THEN one || chr(10) || '{{bad ' || o_orderkey || '}}'
      ELSE CAST(o_orderkey AS VARCHAR) END AS content
  FROM (SELECT *, '{{"id": ' || o_orderkey || ', "priority": "' || o_orderpriority || '"}}' AS one,
               '{{"customer": "' || o_custkey || '"}}' AS two FROM orders))"""

ENVELOPES_SQL = f"""envelopes AS (
  SELECT o_orderkey, o_orderpriority, {_case('o_orderstatus', PAYLOAD_DATASETS)} AS dataset,
    CASE WHEN o_totalprice < 50000 THEN 'bulk' ELSE 'generic' END AS pipeline,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN '[{{"b": "x", "id": ' || o_orderkey || '}}, {{"a": null}}]'
      WHEN '2-HIGH' THEN '[{{"id": ' || o_orderkey || '}}]' END AS records
  FROM orders)"""

JSON_KEYS_SQL = """json_keys AS (
  SELECT o_orderkey, CASE o_orderpriority
    WHEN '2-HIGH' THEN o_custkey || '.0'
    WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END
    WHEN '5-LOW' THEN CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'True' END
    ELSE CAST(o_custkey AS VARCHAR) END AS key FROM orders)"""

LABELLED_SQL = """labelled AS (
  SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""

MARKERS_SQL = f"""live_markers AS (
  SELECT event_id FROM events WHERE event_type IN ('view', 'click')
    AND ts <= TIMESTAMP '{EVENTS_AS_OF}' AND ts + INTERVAL 24 HOUR > TIMESTAMP '{EVENTS_AS_OF}')"""

STEPS_SQL = """steps AS (
  SELECT *, CASE WHEN delivery > 3 THEN 'dead_lettered' WHEN value < 35 THEN 'dispatched'
                 ELSE 'pending' END AS effect
  FROM (
    SELECT *, min(CASE WHEN value < 35 OR delivery > 3 THEN delivery END)
              OVER (PARTITION BY user_id, event_type) AS last_delivery
    FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS delivery
      FROM events))
  WHERE last_delivery IS NULL OR delivery <= last_delivery)"""


def json_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON records whose id is a number, a number with a fraction, a text or a boolean."""
    key, kind = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    even = F.col("o_custkey") % 2 == 0
    text = (
        F.when(kind == "2-HIGH", F.concat(key, F.lit(".0")))
        .when(kind == "3-MEDIUM", F.concat(F.lit('"'), key, F.lit('"')))
        .when(kind == "4-NOT SPECIFIED", F.when(even, "true").otherwise("false"))
        .when(kind == "5-LOW", F.when(even, '"true"').otherwise('"True"'))
        .otherwise(key)
    )
    record = F.concat(F.lit('{"id": '), text, F.lit("}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(record).alias("rec"))
