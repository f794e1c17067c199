"""Queries over mergeable sketches; their SQL is the exact computation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vouchsafe.operators import sketches as S
from vouchsafe.plans import bindings as B
from vouchsafe.plans.registry import query
from vouchsafe.settings import GateThresholds

BAR = GateThresholds().uniqueness
RANK_ERROR = 0.01


def _unique_sql(name: str, key: str) -> str:
    return f"""SELECT '{name}' AS key_name, l_returnflag AS part, count(*) AS rows,
  count(DISTINCT {key}) / count(*) >= {BAR} AS passed, true AS decided FROM lineitem GROUP BY 2
UNION ALL SELECT '{name}', 'all', count(*), count(DISTINCT {key}) / count(*) >= {BAR}, true FROM lineitem"""


@query(
    _unique_sql("line", "l_orderkey || '/' || l_linenumber")
    + " UNION ALL " + _unique_sql("order", "l_orderkey")
)
def gate_uniqueness_sketched(spark, sf_dir):
    """The uniqueness gate from sketches, for each part of the lines and, merged, for all of them."""
    lineitem = B.table(spark, sf_dir, "lineitem")
    keys = {"line": F.concat_ws("/", "l_orderkey", "l_linenumber"), "order": F.col("l_orderkey")}
    judged = []
    for name, key in keys.items():
        parts = S.sketch(lineitem, [F.col("l_returnflag").alias("part")], key)
        whole = S.merge(parts, []).withColumn("part", F.lit("all"))
        both = parts.unionByName(whole)
        judged.append(
            S.uniqueness(both, BAR).select(F.lit(name).alias("key_name"), "part", "rows", "passed", "decided")
        )
    return reduce(lambda a, b: a.unionByName(b), judged)


@query(
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(value) AS total,
  true AS p50_holds, true AS p95_holds
FROM events GROUP BY 1, 2"""
)
def latency_quantiles_sketched(spark, sf_dir):
    """Quantiles of a day from sketches of six hours, judged by the ranks they have among the day's events."""
    events = B.table(spark, sf_dir, "events")
    hours = S.sketch(
        events, [F.window("ts", "6 hours").alias("w"), F.col("event_type")], F.col("user_id"), F.col("value")
    )
    day = F.window("ts", "1 day")
    days = S.merge(
        hours.withColumn("ts", F.col("w.start")), [day.alias("w"), F.col("event_type")]
    ).select(
        F.col("w.start").alias("day"), "event_type", F.col("values").alias("total"),
        S.quantile(0.5).alias("p50"), S.quantile(0.95).alias("p95"),
    )
    own = events.select(day.alias("w"), "event_type", "value").select(
        F.col("w.start").alias("day"), "event_type", "value"
    )

    def holds(name: str, share: float):
        value, estimate = F.col("value"), F.col(name)
        below = F.count_if(value < estimate) / F.max("total")
        upto = F.count_if(value <= estimate) / F.max("total")
        return (below - RANK_ERROR <= share) & (upto + RANK_ERROR >= share)

    return (
        own.join(days, ["day", "event_type"]).groupBy("day", "event_type")
        .agg(
            F.max("total").alias("total"),
            holds("p50", 0.5).alias("p50_holds"), holds("p95", 0.95).alias("p95_holds"),
        )
    )
