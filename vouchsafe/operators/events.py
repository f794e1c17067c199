"""Event bus operators over event tables: the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vouchsafe.session import cut_lineage
from vouchsafe.settings import Settings

DEFAULTS = Settings()
MICROS = 1_000_000

# A key with at most this many moments is folded in one array; beyond, by pointer doubling.
MAX_MOMENTS_PER_FOLD = 50_000

DISPATCHED, DEAD_LETTERED, PENDING = "dispatched", "dead_lettered", "pending"


def dedup_ttl(
    events: DataFrame,
    keys: list[str],
    at: str = "ts",
    event_id: str = "event_id",
    ttl_seconds: int = DEFAULTS.idempotency_ttl_seconds,
    max_moments_per_fold: int = MAX_MOMENTS_PER_FOLD,
) -> DataFrame:
    """Events that idempotent publishing accepts: ``keys, at, event_id``.

    Per key the first event is accepted and locks the key for a fixed time; events
    meanwhile are duplicates and do not extend the lock. An event with a null in
    its key is never a duplicate.
    """
    keyless = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    # One moment per key and timestamp: only its lowest event id can be accepted.
    moments = (
        events.where(~keyless)
        .groupBy(*keys, at)
        .agg(F.min(event_id).alias(event_id))
        .withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    )
    ttl = ttl_seconds * MICROS
    sizes = moments.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= max_moments_per_fold:
        accepted = _accept_by_fold(moments, keys, at, event_id, ttl)
    else:
        hot = sizes.where(F.col("_n") > max_moments_per_fold).select(*keys)
        accepted = _accept_by_fold(
            moments.join(hot, keys, "left_anti"), keys, at, event_id, ttl
        ).unionAll(
            _accept_by_doubling(moments.join(hot, keys, "left_semi"), keys, at, event_id, ttl)
        )
    return accepted.unionAll(events.where(keyless).select(*keys, at, event_id))


def _accept_by_fold(
    moments: DataFrame, keys: list[str], at: str, event_id: str, ttl: int
) -> DataFrame:
    moment = F.struct("_t", F.col(event_id).alias("id"), F.col(at).alias("at"))
    in_order = F.array_sort(F.collect_list(moment))

    def step(kept: Column, m: Column) -> Column:
        free = (F.size(kept) == 0) | (m["_t"] >= F.element_at(kept, -1)["_t"] + ttl)
        return F.when(free, F.array_append(kept, m)).otherwise(kept)

    element = moments.select(moment.alias("m")).schema["m"].dataType.simpleString()
    nothing = F.array().cast(f"array<{element}>")
    return (
        moments.groupBy(*keys)
        .agg(in_order.alias("ms"))
        .select(*keys, F.explode(F.aggregate("ms", nothing, step)).alias("m"))
        .select(*keys, F.col("m.at").alias(at), F.col("m.id").alias(event_id))
    )


def _accept_by_doubling(
    moments: DataFrame, keys: list[str], at: str, event_id: str, ttl: int
) -> DataFrame:
    """For keys too hot for one task: follow "first moment after the lock" in powers of two.

    Each moment points to the moment that would be accepted next after it. The
    accepted ones are those reached from a key's first moment; composing the
    pointers with themselves reaches twice as far in every round, and a round is
    a join on (key, moment), which no hot key can skew.
    """
    moments = cut_lineage(moments)
    probes = moments.select(*keys, F.col("_t"), (F.col("_t") + ttl).alias("_x"))
    found = _first_at_or_after(
        moments.select(*keys, "_t"), probes.select(*keys, "_x"), keys, [MICROS, 3600 * MICROS]
    )
    jump = cut_lineage(
        probes.join(found, [*keys, "_x"]).select(*keys, "_t", F.col("_found").alias("_next"))
    )
    reached = cut_lineage(moments.groupBy(*keys).agg(F.min("_t").alias("_t")))
    while True:
        further = cut_lineage(
            reached.join(jump, [*keys, "_t"]).select(*keys, F.col("_next").alias("_t"))
        )
        if further.isEmpty():
            break
        reached = reached.unionAll(further)
        onward = jump.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_after"))
        jump = cut_lineage(
            jump.join(onward, [*keys, "_next"]).select(*keys, "_t", F.col("_after").alias("_next"))
        )
    return moments.join(reached, [*keys, "_t"], "left_semi").select(*keys, at, event_id)


def _first_at_or_after(
    points: DataFrame, probes: DataFrame, keys: list[str], widths: list[int]
) -> DataFrame:
    """For each probe ``_x``, the first point ``_t >= _x`` of its key, as ``_found``.

    Points and probes meet in time slots, so a window spans one slot of one key: a
    one-second slot holds at most a million microseconds. What finds nothing in its
    slot asks, once per slot, among the first points of the later slots.
    """
    slot = F.floor(F.col("_v") / F.lit(widths[0])) if widths else F.lit(0)
    marks = (
        points.select(*keys, F.col("_t").alias("_v"), F.lit(0).alias("_probe"))
        .unionAll(
            probes.distinct().select(*keys, F.col("_x").alias("_v"), F.lit(1).alias("_probe"))
        )
        .withColumn("_slot", slot)
    )
    backwards = (
        Window.partitionBy(*keys, "_slot")
        .orderBy(F.desc("_v"), F.asc("_probe"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    met = (
        marks.withColumn("_found", F.min(F.when(F.col("_probe") == 0, F.col("_v"))).over(backwards))
        .where("_probe = 1")
        .select(*keys, F.col("_v").alias("_x"), "_slot", "_found")
    )
    if not widths:
        return met.where(F.col("_found").isNotNull()).drop("_slot")
    slot_end = ((F.col("_slot") + 1) * widths[0]).cast("bigint")
    missed = met.where(F.col("_found").isNull()).select(*keys, "_x", slot_end.alias("_end"))
    heads = (
        points.groupBy(*keys, F.floor(F.col("_t") / F.lit(widths[0])).alias("_slot"))
        .agg(F.min("_t").alias("_t"))
        .drop("_slot")
    )
    later = _first_at_or_after(
        heads, missed.select(*keys, F.col("_end").alias("_x")), keys, widths[1:]
    ).withColumnRenamed("_x", "_end")
    return (
        met.where(F.col("_found").isNotNull())
        .drop("_slot")
        .unionAll(missed.join(later, [*keys, "_end"]).select(*keys, "_x", "_found"))
    )


def live_markers(
    markers: DataFrame, as_of: Column, ttl_seconds: int = DEFAULTS.dispatch_ttl_seconds
) -> DataFrame:
    """Dispatch markers ``(event_id, marked_at)`` that have not expired at ``as_of``."""
    expires = F.col("marked_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    return markers.where((F.col("marked_at") <= as_of) & (expires > as_of))


def undispatched(
    events: DataFrame, markers: DataFrame, as_of: Column,
    ttl_seconds: int = DEFAULTS.dispatch_ttl_seconds,
) -> DataFrame:
    """Events without a live marker. Event ids are unique, so the join is even."""
    return events.join(live_markers(markers, as_of, ttl_seconds), "event_id", "left_anti")


def undispatched_at(changes: DataFrame, as_of: Column) -> DataFrame:
    """The ids of the events that lacked a live marker at ``as_of``, from the stream's changes up to then."""
    latest = changes.where(F.col("at") <= as_of).groupBy("event_id").agg(F.max_by("undispatched", "at").alias("_waits"))
    return latest.where("_waits").select("event_id")


def claim_batch(
    backlog: DataFrame,
    fresh: DataFrame,
    markers: DataFrame,
    as_of: Column,
    order: list[str],
    batch_size: int = DEFAULTS.relay_batch_size,
    ttl_seconds: int = DEFAULTS.dispatch_ttl_seconds,
) -> DataFrame:
    """What each consumer gets in its next tick.

    A consumer's unacknowledged backlog comes first, and new events only where it
    has none. The batch is filled before already dispatched events are skipped.
    """
    oldest = Window.partitionBy("consumer").orderBy(*order)

    def batch(rows: DataFrame, deliveries: Column) -> DataFrame:
        return (
            rows.withColumn("_rn", F.row_number().over(oldest))
            .where(F.col("_rn") <= batch_size)
            .drop("_rn")
            .withColumn("deliveries", deliveries)
        )

    busy = backlog.select("consumer").distinct()
    claimed = batch(backlog, F.col("deliveries") + 1).unionByName(
        batch(fresh.join(busy, "consumer", "left_anti"), F.lit(1).cast("bigint"))
    )
    return claimed.join(live_markers(markers, as_of, ttl_seconds), "event_id", "left_anti")


def relay_steps(
    attempts: DataFrame, message: list[str], order: list[str], ok: str,
    max_deliveries: int = DEFAULTS.max_deliveries,
) -> DataFrame:
    """The delivery attempts that take place, each with its effect.

    An attempt beyond the allowed number dead-letters the message; a success ends
    it; a failure leaves it pending. Only the first few attempts of a message can
    matter, and the rest is cut off before the shuffle.
    """
    first = Window.partitionBy(*message).orderBy(*order)
    tried = attempts.withColumn("delivery", F.row_number().over(first)).where(
        F.col("delivery") <= max_deliveries + 1
    )
    effect = (
        F.when(F.col("delivery") > max_deliveries, DEAD_LETTERED)
        .when(F.col(ok), DISPATCHED)
        .otherwise(PENDING)
    )
    ended_before = F.max(F.col("effect") != PENDING).over(
        first.rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        tried.withColumn("effect", effect)
        .withColumn("_over", F.coalesce(ended_before, F.lit(False)))
        .where(~F.col("_over"))
        .drop("_over")
    )


def delivery_outcomes(steps: DataFrame, message: list[str]) -> DataFrame:
    """Per message, how it stands after its last attempt, and the attempts it took."""
    return steps.groupBy(*message).agg(
        F.max_by("effect", "delivery").alias("outcome"),
        F.max("delivery").cast("bigint").alias("deliveries"),
    )


def relay_report(steps: DataFrame, tick: Column) -> DataFrame:
    return steps.groupBy(tick.alias("tick")).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("effect") == DISPATCHED).alias("redispatched"),
        F.count_if(F.col("effect") == DEAD_LETTERED).alias("dead_lettered"),
        F.count_if(F.col("effect") == PENDING).alias("retry_pending"),
    )


def dead_letters(
    steps: DataFrame, original_id: str, event_type: str, payload: str,
    max_deliveries: int = DEFAULTS.max_deliveries,
) -> DataFrame:
    return steps.where(F.col("effect") == DEAD_LETTERED).select(
        F.col(original_id).alias("original_id"),
        F.coalesce(F.col(event_type), F.lit("unknown")).alias("type"),
        F.col(payload).alias("payload"),
        F.lit(f"exceeded {max_deliveries} delivery attempts").alias("error"),
    )


def bus_stats(outcomes: DataFrame, markers: DataFrame, as_of: Column) -> DataFrame:
    """One row: pending, all, dead-lettered messages, and live dispatch markers."""
    live = live_markers(markers, as_of).agg(F.count(F.lit(1)).alias("n")).scalar()
    return outcomes.agg(
        F.count_if(F.col("outcome") == PENDING).alias("pending"),
        F.count(F.lit(1)).alias("stream_length"),
        F.count_if(F.col("outcome") == DEAD_LETTERED).alias("dlq_length"),
    ).withColumn("dispatched", live)
