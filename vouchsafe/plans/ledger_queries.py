"""Registered queries: ledger, audit, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchsafe.functions.identifiers import route_template
from vouchsafe.operators import audit as A
from vouchsafe.operators import events as V
from vouchsafe.operators import windows as W
from vouchsafe.operators import ledger as L
from vouchsafe.plans import bindings as B
from vouchsafe.plans.registry import query

# ---------------------------------------------------------------- ledger


@query(
    f"""WITH {B.PROMOTIONS_SQL}, {B.REPORTS_SQL},
newest AS (
  SELECT n.dataset, max(r.version_id) AS version_id
  FROM reports r JOIN names n USING (version_id) GROUP BY 1),
verdicts AS (
  SELECT n.dataset, n.version_id, bool_and(r.passed) AS passed,
         string_agg(r.check_name, ', ' ORDER BY r.check_name) FILTER (WHERE NOT r.passed) AS failed
  FROM newest n JOIN reports r USING (version_id) GROUP BY 1, 2)
SELECT v.dataset, v.version_id, CASE WHEN passed THEN 'promoted' ELSE 'rejected' END AS decision,
  s.version_id AS from_target, CASE WHEN passed THEN v.version_id END AS to_target,
  CASE WHEN passed THEN 'all quality gates passed' ELSE 'failed gates: ' || failed END AS reason
FROM verdicts v LEFT JOIN serving s USING (dataset)"""
)
def promotion_decisions(spark, sf_dir):
    """The newest judged version of each dataset is decided on."""
    names = B.version_names(spark, sf_dir).select("version_id", "dataset")
    reports = B.reports(spark, sf_dir).join(names, "version_id")
    newest = reports.groupBy("dataset").agg(F.max("version_id").alias("version_id"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check_name"))))
    verdicts = (
        reports.join(newest, ["dataset", "version_id"])
        .groupBy("dataset", "version_id")
        .agg(F.bool_and("passed").alias("passed"), failed.alias("failed_checks"))
    )
    return L.decisions(verdicts, L.serving_alias(B.promotions(spark, sf_dir)))


@query(f"WITH {B.PROMOTIONS_SQL} SELECT dataset, version_id, ledger_id, position FROM history WHERE position <= 50")
def promotion_history(spark, sf_dir):
    history = L.promotion_history(B.promotions(spark, sf_dir))
    return history.withColumn("position", F.col("position").cast("bigint"))


@query(
    f"""WITH {B.PROMOTIONS_SQL}
SELECT h.dataset, arg_min(h.version_id, position) AS previous_version
FROM history h JOIN serving s USING (dataset) WHERE h.version_id <> s.version_id GROUP BY 1"""
)
def previous_promoted(spark, sf_dir):
    promotions = B.promotions(spark, sf_dir)
    current = L.serving_alias(promotions).select(
        "dataset", F.concat_ws("__", "dataset", "version_id").alias("current")
    )
    return L.previous_promoted(promotions, current)


@query(f"WITH {B.PROMOTIONS_SQL} SELECT dataset, version_id, id AS ledger_id FROM serving")
def serving_alias(spark, sf_dir):
    return L.serving_alias(B.promotions(spark, sf_dir))


@query(
    f"""WITH {B.PROMOTIONS_SQL}, placed AS (
  SELECT s.dataset, s.version_id AS current_version, coalesce(h.position, 0) AS place
  FROM serving s LEFT JOIN history h USING (dataset, version_id)),
targets AS (
  SELECT h.dataset, arg_min(h.version_id, h.position) AS target_version
  FROM history h JOIN placed p ON p.dataset = h.dataset
   AND h.position > p.place AND h.version_id <> p.current_version
  JOIN live l ON l.dataset = h.dataset AND l.version_id = h.version_id GROUP BY 1)
SELECT p.dataset, current_version, target_version,
  CASE WHEN target_version IS NULL THEN 'rollback_failed' ELSE 'rolled_back' END AS decision
FROM placed p LEFT JOIN targets t USING (dataset)"""
)
def rollback_target(spark, sf_dir):
    return L.rollback_targets(B.promotions(spark, sf_dir), B.live_collections(spark, sf_dir))


@query(
    f"""WITH {B.PROMOTIONS_SQL}, previous AS (
  SELECT h.dataset, arg_min(h.version_id, position) AS version_id
  FROM history h JOIN serving s USING (dataset) WHERE h.version_id <> s.version_id GROUP BY 1),
keep AS (SELECT dataset, version_id FROM serving UNION SELECT dataset, version_id FROM previous),
candidates AS (
  SELECT l.*, row_number() OVER (
           PARTITION BY dataset ORDER BY ledger_id ASC NULLS FIRST, version_id) AS rn,
         count(*) OVER (PARTITION BY dataset) AS n
  FROM (SELECT live.*, h.ledger_id FROM live LEFT JOIN history h USING (dataset, version_id)) l
  ANTI JOIN keep USING (dataset, version_id))
SELECT c.dataset, c.version_id FROM candidates c
JOIN (SELECT dataset, count(*) AS k FROM keep GROUP BY 1) USING (dataset)
WHERE rn <= greatest(0, n - (3 - k))"""
)
def retention_drops(spark, sf_dir):
    promotions = B.promotions(spark, sf_dir)
    serving = L.serving_alias(promotions).select("dataset", "version_id")
    previous = L.previous_promoted(
        promotions, serving.withColumnRenamed("version_id", "current")
    ).withColumnRenamed("previous_version", "version_id")
    return L.retention_drops(
        B.live_collections(spark, sf_dir), serving.unionByName(previous), promotions
    )


@query(
    f"""WITH {B.TRANSITIONS_SQL}
SELECT t.version_id, arg_max(status, (moved_at, seq)) AS status,
  arg_max(record_count, (moved_at, seq)) FILTER (WHERE record_count IS NOT NULL) AS record_count,
  max(moved_at) AS updated_at FROM transitions t GROUP BY 1"""
)
def latest_status(spark, sf_dir):
    return L.latest_status(B.transitions(spark, sf_dir))


@query(
    f"""WITH {B.VERSIONS_SQL}
SELECT dataset, version_id, status, created_at FROM versions
ORDER BY created_at DESC NULLS LAST, version_id DESC LIMIT 50"""
)
def list_versions(spark, sf_dir):
    return L.list_versions(B.versions(spark, sf_dir)).select(
        "dataset", "version_id", "status", "created_at"
    )


@query(
    f"""WITH {B.LEDGER_SQL}
SELECT id, version_id, decision, decided_at FROM ledger ORDER BY decided_at DESC, id DESC LIMIT 50"""
)
def list_promotions(spark, sf_dir):
    return L.list_promotions(B.ledger_rows(spark, sf_dir))


@query(
    f"""WITH {B.PROMOTIONS_SQL}, {B.REPORTS_SQL}
SELECT r.version_id, check_name, passed, score, r.threshold, r.created_at
FROM reports r SEMI JOIN promotions p ON p.version_id = r.version_id AND p.decision = 'promoted'"""
)
def quality_by_version(spark, sf_dir):
    """Reports of every version that was ever promoted, oldest first."""
    promoted = B.promotions(spark, sf_dir).where("decision = 'promoted'")
    return (
        B.reports(spark, sf_dir)
        .join(promoted, "version_id", "left_semi")
        .select("version_id", "check_name", "passed", "score", "threshold", "created_at")
        .orderBy("version_id", "created_at", "check_name")
    )


@query(
    f"""WITH {B.VERSIONS_SQL}, {B.REPORTS_SQL}, {B.QUARANTINE_SQL}, items AS (
  SELECT version_id, 'check' AS kind, check_name AS name, passed, score FROM reports
  UNION ALL SELECT version_id, 'quarantine', reason, NULL, NULL FROM quarantine)
SELECT v.version_id, v.dataset, v.status, kind, name, passed, score
FROM versions v LEFT JOIN items i USING (version_id)"""
)
def version_lineage(spark, sf_dir):
    versions = B.versions(spark, sf_dir).select("version_id", "dataset", "status")
    return L.version_detail(versions, B.reports(spark, sf_dir), B.quarantine(spark, sf_dir))


@query(
    f"""WITH {B.PROMOTIONS_SQL}
SELECT id, version_id, decision, decided_at FROM ledger
WHERE version_id NOT IN (SELECT version_id FROM live)"""
)
def orphan_rows(spark, sf_dir):
    """Ledger rows whose version has lost its collection."""
    return L.orphans(B.ledger_rows(spark, sf_dir), B.live_collections(spark, sf_dir)).select(
        "id", "version_id", "decision", "decided_at"
    )


# ---------------------------------------------------------------- audit

_AS_OF = f"TIMESTAMP '{B.LEDGER_AS_OF}'"


def _last(column: str, hours: int) -> str:
    return f"{column} > {_AS_OF} - INTERVAL {hours} HOUR AND {column} <= {_AS_OF}"


@query(
    f"""WITH {B.LEDGER_SQL}
SELECT decision, count(*) AS decisions FROM ledger WHERE {_last('decided_at', 24)} GROUP BY 1"""
)
def audit_decisions(spark, sf_dir):
    return A.decision_counts(B.ledger_rows(spark, sf_dir), B.ntz(B.LEDGER_AS_OF))


@query(
    f"""WITH {B.VERSIONS_SQL}, {B.QUARANTINE_SQL}
SELECT v.dataset, count(*) AS records FROM quarantine q JOIN names v USING (version_id)
WHERE {_last('q.created_at', 24)} GROUP BY 1"""
)
def audit_quarantine(spark, sf_dir):
    return A.quarantine_by_dataset(
        B.quarantine(spark, sf_dir), B.version_names(spark, sf_dir), B.ntz(B.LEDGER_AS_OF)
    )


_STUCK_SQL = f"""status NOT IN ('promoted', 'rejected', 'rolled_back')
  AND updated_at < {_AS_OF} - INTERVAL 2 HOUR"""


@query(f"WITH {B.VERSIONS_SQL} SELECT version_id, status FROM versions WHERE {_STUCK_SQL}")
def audit_stuck(spark, sf_dir):
    return A.stuck_versions(B.versions(spark, sf_dir), B.ntz(B.LEDGER_AS_OF))


@query(
    f"""WITH {B.VERSIONS_SQL}, {B.LEDGER_SQL}, d AS (
  SELECT count(*) FILTER (WHERE decision = 'promoted') AS promoted,
         count(*) FILTER (WHERE decision = 'rejected') AS rejected,
         (SELECT count(*) FROM versions WHERE {_STUCK_SQL}) AS stuck
  FROM ledger WHERE {_last('decided_at', 24)}),
r AS (SELECT *, coalesce(rejected / nullif(promoted + rejected, 0), 0.0) AS rate FROM d)
SELECT promoted, rejected, stuck, rate <= 0.25 AND stuck = 0 AS healthy,
       round(rate, 3) AS failure_rate, NOT (rate <= 0.25 AND stuck = 0) AS alert FROM r"""
)
def audit_health(spark, sf_dir):
    return A.health(
        B.ledger_rows(spark, sf_dir), B.versions(spark, sf_dir), B.ntz(B.LEDGER_AS_OF)
    )


@query(
    f"""WITH {B.QUARANTINE_SQL}
SELECT count(*) AS value FROM quarantine WHERE {_last('created_at', 24)}"""
)
def quarantine_24h(spark, sf_dir):
    return A.quarantine_total(B.quarantine(spark, sf_dir), B.ntz(B.LEDGER_AS_OF))


@query(
    f"""WITH {B.VERSIONS_SQL}
SELECT dataset, status, count(*) AS versions, max(created_at) AS latest FROM versions GROUP BY 1, 2"""
)
def versions_by_status(spark, sf_dir):
    return A.versions_by_status(B.versions(spark, sf_dir))


@query(
    f"""WITH {B.REPORTS_SQL}
SELECT check_name, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 3) AS pass_rate, count(*) AS runs
FROM reports WHERE created_at > TIMESTAMP '{B.REPORTS_AS_OF}' - INTERVAL 168 HOUR
  AND created_at <= TIMESTAMP '{B.REPORTS_AS_OF}' GROUP BY 1"""
)
def gate_pass_by_check(spark, sf_dir):
    return A.pass_rate_by_check(B.reports(spark, sf_dir), B.ntz(B.REPORTS_AS_OF))


@query(
    f"""WITH {B.PROMOTIONS_SQL}
SELECT 'promoted' AS metric, '' AS label, CAST(count(*) AS VARCHAR) AS value
FROM promotions WHERE decision = 'promoted'
UNION ALL SELECT 'rejected', '', CAST(count(*) AS VARCHAR) FROM promotions WHERE decision = 'rejected'
UNION ALL SELECT 'rolled_back', '', CAST(count(*) AS VARCHAR) FROM promotions WHERE decision = 'rolled_back'
UNION ALL SELECT 'versions', '', CAST(count(*) AS VARCHAR) FROM names
UNION ALL SELECT 'datasets', '', CAST(count(DISTINCT dataset) AS VARCHAR) FROM names
UNION ALL SELECT 'collections', '', CAST(count(*) AS VARCHAR) FROM live
UNION ALL SELECT 'serving', d.dataset, s.version_id
FROM (SELECT DISTINCT dataset FROM names) d LEFT JOIN serving s USING (dataset)"""
)
def plane_stats(spark, sf_dir):
    return A.plane_stats(
        B.promotions(spark, sf_dir), B.version_names(spark, sf_dir), B.live_collections(spark, sf_dir)
    )


@query(
    """WITH e AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS m, event_type FROM events)
SELECT m - k * INTERVAL 1 MINUTE AS window_start, event_type AS label, count(*) / 300.0 AS rate
FROM e, range(5) r(k) GROUP BY 1, 2"""
)
def event_rate_sliding(spark, sf_dir):
    return A.sliding_rate(B.table(spark, sf_dir, "events"), "event_type")


_BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


def _quantile_sql() -> str:
    lows = (0.0, *_BOUNDS[:-1])
    arms = []
    for i, (low, high) in enumerate(zip(lows, _BOUNDS)):
        below = f"c{i - 1}" if i else "0"
        arms.append(
            f"WHEN c{i} >= rank THEN {low}::DOUBLE + ({high} - {low}) * ((rank - {below}) / nullif(c{i} - {below}, 0))"
        )
    counts = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS c{i}" for i, b in enumerate(_BOUNDS))
    return f"""WITH h AS (
  SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS total,
         count(*) * 0.95::DOUBLE AS rank, {counts} FROM events GROUP BY 1, 2)
SELECT window_start, event_type, total,
  round(CASE {' '.join(arms)} ELSE {_BOUNDS[-1]} END, 6) AS p95 FROM h"""


@query(_quantile_sql())
def latency_p95(spark, sf_dir):
    """p95 of the event value per six hours and type."""
    events = B.table(spark, sf_dir, "events")
    window = F.window("ts", "6 hours")
    p95 = A.histogram_quantile(
        events, [window.alias("w"), F.col("event_type")], "value", 0.95, _BOUNDS
    )
    return p95.select(
        F.col("w.start").alias("window_start"), "event_type", "total",
        F.round("quantile", 6).alias("p95"),
    )


@query(
    """WITH p AS (SELECT '/' || array_to_string(string_split(url, '/')[4:], '/') AS path FROM pages)
SELECT CASE WHEN starts_with(path, '/en/') THEN '/en/{param}' WHEN starts_with(path, '/fr/') THEN '/fr/{param}'
  ELSE path END AS route, count(*) AS requests FROM p GROUP BY 1"""
)
def route_template_counts(spark, sf_dir):
    path = F.concat(
        F.lit("/"),
        F.array_join(F.slice(F.split("url", "/"), 4, F.greatest(F.size(F.split("url", "/")), F.lit(1))), "/"),
    )
    return (
        B.table(spark, sf_dir, "pages")
        .groupBy(route_template(path, ("/en/", "/fr/")).alias("route"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )


# ---------------------------------------------------------------- windows

# Events are taken to arrive half an hour later for each unit of their value, and in hourly batches.
_DELAY = 1_800_000_000
_ARRIVALS_SQL = f"""a AS (
  SELECT *, CAST(floor((epoch_us(ts) + CAST(floor(value * {_DELAY}) AS BIGINT)) / 3600000000) AS BIGINT) AS batch FROM events),
marks AS (
  SELECT batch, max(seen) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 12 HOUR AS mark
  FROM (SELECT batch, max(ts) AS seen FROM a GROUP BY 1))"""


def _arriving(spark, sf_dir):
    delay = F.floor(F.col("value") * _DELAY)
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + delay
    return B.table(spark, sf_dir, "events").withColumn("batch", F.floor(arrival / 3_600_000_000))


@query(
    f"""WITH {_ARRIVALS_SQL},
judged AS (
  SELECT a.*, time_bucket(INTERVAL 6 HOUR, ts) AS window_start,
    coalesce(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= mark, false) AS late FROM a JOIN marks USING (batch))
SELECT event_type, window_start, count(*) FILTER (NOT late) AS n, min(value) FILTER (NOT late) AS least,
  max(value) FILTER (NOT late) AS greatest, count(*) FILTER (late) AS n_late FROM judged GROUP BY 1, 2"""
)
def event_windows_late(spark, sf_dir):
    """Six-hour windows by type: rows whose window had ended when they arrived count apart."""
    return W.tumbling_windows(
        _arriving(spark, sf_dir), ["event_type"], "ts", "value", "batch", width_seconds=6 * 3600, lateness_seconds=12 * 3600
    )


@query(
    """WITH e AS (
  SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, max(value) AS greatest FROM s GROUP BY user_id, session"""
)
def event_sessions(spark, sf_dir):
    """Each user's sessions: events that follow each other in less than eight hours."""
    return W.session_windows(B.table(spark, sf_dir, "events"), ["user_id"], "ts", "value", gap_seconds=8 * 3600)


# ---------------------------------------------------------------- events


@query(
    """WITH RECURSIVE moments AS (
  SELECT event_type, props, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3),
accepted AS (
  SELECT event_type, props, min(ts) AS ts FROM moments GROUP BY 1, 2
  UNION ALL
  SELECT a.event_type, a.props, (
    SELECT min(m.ts) FROM moments m WHERE m.event_type = a.event_type AND m.props = a.props
      AND m.ts >= a.ts + INTERVAL 24 HOUR) AS ts
  FROM accepted a WHERE a.ts IS NOT NULL)
SELECT m.event_type, m.props, m.ts, m.event_id
FROM moments m JOIN (SELECT DISTINCT * FROM accepted) a USING (event_type, props, ts)"""
)
def dedup_ttl(spark, sf_dir):
    return V.dedup_ttl(B.table(spark, sf_dir, "events"), ["event_type", "props"])


@query(
    f"""WITH {B.MARKERS_SQL}
SELECT event_id, ts, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM live_markers)"""
)
def undispatched_events(spark, sf_dir):
    events = B.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return V.undispatched(events, B.markers(spark, sf_dir), B.ntz(B.EVENTS_AS_OF))


@query(
    f"""WITH {B.MARKERS_SQL},
backlog AS (SELECT user_id AS consumer, event_id, ts FROM events WHERE event_type = 'click' AND value > 100),
fresh AS (
  SELECT user_id AS consumer, event_id, ts FROM events
  WHERE event_type <> 'click' AND user_id NOT IN (SELECT consumer FROM backlog)),
claimed AS (
  SELECT *, CAST(2 AS BIGINT) AS deliveries FROM backlog
  QUALIFY row_number() OVER (PARTITION BY consumer ORDER BY ts, event_id) <= 50
  UNION ALL
  SELECT *, CAST(1 AS BIGINT) FROM fresh
  QUALIFY row_number() OVER (PARTITION BY consumer ORDER BY ts, event_id) <= 50)
SELECT * FROM claimed WHERE event_id NOT IN (SELECT event_id FROM live_markers)"""
)
def claim_batch(spark, sf_dir):
    """Every user is a consumer; costly clicks were delivered once and not acknowledged."""
    events = B.table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("consumer"), "event_id", "ts", "event_type", "value")
    was_delivered = (F.col("event_type") == "click") & (F.col("value") > 100)
    backlog = rows.where(was_delivered).withColumn("deliveries", F.lit(1).cast("bigint"))
    fresh = rows.where(F.col("event_type") != "click")
    return V.claim_batch(
        backlog.drop("event_type", "value"), fresh.drop("event_type", "value"),
        B.markers(spark, sf_dir), B.ntz(B.EVENTS_AS_OF), ["ts", "event_id"],
    )


def _steps(spark, sf_dir):
    return V.relay_steps(B.attempts(spark, sf_dir), B.MESSAGE, ["ts", "event_id"], "ok")


@query(
    f"""WITH {B.STEPS_SQL}
SELECT user_id, event_type, arg_max(effect, delivery) AS outcome, max(delivery) AS deliveries
FROM steps GROUP BY 1, 2"""
)
def delivery_outcomes(spark, sf_dir):
    return V.delivery_outcomes(_steps(spark, sf_dir), B.MESSAGE)


@query(
    f"""WITH {B.STEPS_SQL}
SELECT CAST(ts AS DATE) AS tick, count(*) AS scanned,
  count(*) FILTER (WHERE effect = 'dispatched') AS redispatched,
  count(*) FILTER (WHERE effect = 'dead_lettered') AS dead_lettered,
  count(*) FILTER (WHERE effect = 'pending') AS retry_pending
FROM steps GROUP BY 1"""
)
def relay_report(spark, sf_dir):
    return V.relay_report(_steps(spark, sf_dir), F.to_date("ts"))


@query(
    f"""WITH {B.STEPS_SQL}
SELECT event_id AS original_id, event_type AS type, props AS payload,
  'exceeded 3 delivery attempts' AS error FROM steps WHERE effect = 'dead_lettered'"""
)
def dead_letters(spark, sf_dir):
    return V.dead_letters(_steps(spark, sf_dir), "event_id", "event_type", "props")


@query(
    f"""WITH {B.STEPS_SQL}, {B.MARKERS_SQL},
outcomes AS (SELECT user_id, event_type, arg_max(effect, delivery) AS outcome FROM steps GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE outcome = 'pending') AS pending, count(*) AS stream_length,
  count(*) FILTER (WHERE outcome = 'dead_lettered') AS dlq_length,
  (SELECT count(*) FROM live_markers) AS dispatched FROM outcomes"""
)
def bus_stats(spark, sf_dir):
    outcomes = V.delivery_outcomes(_steps(spark, sf_dir), B.MESSAGE)
    return V.bus_stats(outcomes, B.markers(spark, sf_dir), B.ntz(B.EVENTS_AS_OF))
