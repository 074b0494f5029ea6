"""Consumer lag: per partition, per topic, per group, over time.

Key of the flow: ``lag_by_partition`` (no shuffle) -> ``topic_lag`` (one partial aggregation) ->
``with_velocity`` (one shuffle on group, topic and time slice) -> ``classify`` and ``score``
(no shuffle) -> ``group_rollup`` (partial aggregation).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULTS, Thresholds
from ..functions.columns import class_multiplier, micros, no_prefix, severity_label
from ..functions.timeline import previous, runs, trailing

SNAPSHOT = ["snapshotted_at", "group_id", "topic"]
SERIES = ["group_id", "topic", "partition"]


# ---------------------------------------------------------------- partitions and groups


def active_groups(groups: DataFrame) -> DataFrame:
    """Consumer groups that are not dead."""
    return groups.filter(F.col("state") != "Dead")


def groups_monitored(snapshots: DataFrame) -> DataFrame:
    """Number of groups seen at each snapshot."""
    return snapshots.groupBy("snapshotted_at").agg(
        F.countDistinct("group_id").alias("groups_monitored")
    )


def is_stalled(last_commit_at: str, now: str, stall_seconds: int) -> Column:
    """True when the last commit is known and older than the limit at the snapshot time."""
    age = micros(now) - micros(last_commit_at)
    return F.coalesce(age > stall_seconds * 1_000_000, F.lit(False))


def lag_by_partition(
    snapshots: DataFrame,
    exclude_prefixes: Sequence[str] = C.LAG_EXCLUDED_PREFIXES,
    keep_zero: bool = True,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Lag of every partition row.

    ``lag`` is never below zero; ``lag_raw`` is the plain difference and may be. A missing
    end offset counts as the committed one, a negative committed offset as zero.
    """
    committed = F.greatest(F.col("committed_offset"), F.lit(0).cast("bigint"))
    end = F.coalesce(F.col("log_end_offset"), committed)
    out = snapshots.filter(no_prefix("topic", exclude_prefixes)).select(
        "group_id",
        "topic",
        "partition",
        committed.alias("committed_offset"),
        end.alias("log_end_offset"),
        F.greatest(end - committed, F.lit(0).cast("bigint")).alias("lag"),
        (end - committed).alias("lag_raw"),
        "last_commit_at",
        is_stalled("last_commit_at", "snapshotted_at", cfg.stall_seconds).alias("is_stalled"),
        "snapshotted_at",
    )
    return out if keep_zero else out.filter("lag > 0")


def topics_with_lag(lags: DataFrame) -> DataFrame:
    """(snapshot, group, topic) triples where at least one partition lags."""
    return lags.groupBy(*SNAPSHOT).agg(F.max("lag").alias("max_lag")).filter("max_lag > 0")


def with_last_commit(snapshots: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Fill ``last_commit_at`` with the latest time the committed offset was seen to change;
    null until a change has been seen. The first commit of a group, from no offset to one, is a
    change too, so the offset is compared inside a struct, which is never null."""
    kept = [c for c in snapshots.columns if c != "last_commit_at"]
    marked = runs(
        snapshots.select(
            *[c for c in kept if c != "committed_offset"], F.struct("committed_offset").alias("_offset")
        ),
        SERIES,
        "snapshotted_at",
        "_offset",
        cfg.bucket_seconds,
        cfg.shuffle_tasks,
    )
    return marked.withColumn("committed_offset", F.col("_offset.committed_offset")).select(
        *kept, F.when(~F.col("run_open"), F.col("run_start")).alias("last_commit_at")
    )


def stalled_partitions(lags: DataFrame) -> DataFrame:
    """Partitions whose consumer has stopped committing."""
    return lags.filter("is_stalled").select(
        *SNAPSHOT, "partition", "committed_offset", "lag", "last_commit_at"
    )


def recent_lag_history(
    lags: DataFrame, minutes: float = 30, asof: str | None = None
) -> DataFrame:
    """Partition rows newer than ``asof`` minus the period; ``asof`` is an ISO time, and the
    newest snapshot of the table where it is left out."""
    span = int(minutes * 60_000_000)
    if asof is not None:
        after = F.timestamp_micros(micros(F.lit(asof).cast("timestamp")) - span)
    else:
        # A scalar subquery: one value, known before the rows are read.
        after = lags.agg(F.timestamp_micros(F.max(micros("snapshotted_at")) - span)).scalar()
    # The bare column is compared, so that readers can skip files and days.
    recent = lags.filter(F.col("snapshotted_at") > after)
    return recent.select(*SERIES, F.col("lag_raw").alias("lag"), "snapshotted_at")


# ---------------------------------------------------------------- topics


def topic_lag(lags: DataFrame) -> DataFrame:
    """One row per (snapshot, group, topic) with everything the class rules need.

    All aggregates have buffers of fixed size, so rows are combined before the shuffle.
    """
    return lags.groupBy(*SNAPSHOT).agg(
        F.sum("lag").alias("total_lag"),
        F.sum("lag_raw").alias("total_lag_raw"),
        F.count(F.lit(1)).alias("partition_rows"),
        F.count_if(F.col("lag") > 0).alias("lagging_partitions"),
        F.count_if(F.col("is_stalled")).alias("stalled_count"),
        F.max("lag").alias("max_lag"),
        F.sum("committed_offset").alias("committed_total"),
        F.sum("log_end_offset").alias("log_end_total"),
    )


def with_velocity(topics: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Add ``lag_velocity_per_min``: change of the total since the oldest snapshot of the
    history, per minute. The history is strictly before the row and newer than the period.

    Zero when the history has fewer than two partition rows, when it is too short, or when the
    topic has no lag. The history sums raw lag, the current total is the clamped one.
    """
    period = int(cfg.history_seconds * 1_000_000)
    usable = F.col("lagging_partitions") > 0 if cfg.drop_zero_lag_history else F.lit(True)

    def frames(w):
        past = w.rangeBetween(-period + 1, -1)
        return {
            "_rows": F.sum(F.when(usable, F.col("partition_rows"))).over(past),
            "_old": F.first(
                F.when(usable, F.struct("total_lag_raw", "_us")), ignorenulls=True
            ).over(past),
            "_now": F.col("_us"),
        }

    out = trailing(
        topics, ["group_id", "topic"], "snapshotted_at", cfg.history_seconds, cfg.bucket_seconds, frames
    )
    elapsed = (F.col("_now") - F.col("_old._us")) / 60_000_000
    velocity = F.when(
        (F.col("total_lag") > 0)
        & (F.col("_rows") >= 2)
        & (elapsed >= cfg.min_elapsed_seconds / 60),
        (F.col("total_lag") - F.col("_old.total_lag_raw")) / elapsed,
    ).otherwise(0.0)
    return out.withColumn("lag_velocity_per_min", velocity).drop("_rows", "_old", "_now")


def classify(topics: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Add ``lag_classification``; the first rule that holds decides."""
    v = F.col("lag_velocity_per_min")
    total = F.col("total_lag")
    stalled = F.col("stalled_count")
    rows = F.col("partition_rows")
    lagging = F.col("lagging_partitions")
    skewed = (F.col("max_lag") > F.try_divide(total, lagging) * cfg.skew_factor) & (lagging < rows)
    rule = (
        F.when(total == 0, C.HEALTHY)
        .when((stalled > 0) & (stalled == rows), C.STALLED)
        .when(stalled > 0, C.SINGLE_STALL)
        .when(skewed, C.SINGLE_STALL)
        .when(v < cfg.catchup_velocity, C.CATCHUP)
        .when(v > cfg.growing_velocity, C.GROWING)
        .when((total > cfg.herd_lag) & (F.abs(v) < cfg.herd_velocity), C.HERD)
        .when(v > 0, C.GROWING)
        .otherwise(C.CATCHUP)
    )
    return topics.withColumn("lag_classification", rule)


def score(classified: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Add ``severity_score`` in 0..1: log-scaled lag times the multiplier of the class."""
    ceiling = math.log10(max(cfg.score_ceiling, 2))
    base = F.log10(F.greatest(F.col("total_lag"), F.lit(1)).cast("double")) / ceiling
    value = F.when(F.col("total_lag") == 0, 0.0).otherwise(
        F.least(
            F.greatest(base * class_multiplier("lag_classification"), F.lit(0.0)), F.lit(1.0)
        )
    )
    return classified.withColumn("severity_score", value)


def analyze_topics(snapshots: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Snapshots to classified and scored topics."""
    topics = topic_lag(lag_by_partition(snapshots, cfg=cfg))
    return score(classify(with_velocity(topics, cfg), cfg), cfg)


def with_severity(scored: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Add the severity name of each score."""
    return scored.withColumn("severity", severity_label("severity_score", cfg))


def problematic_partitions(lags: DataFrame, factor: float = DEFAULTS.problem_factor) -> DataFrame:
    """Partitions with more than ``factor`` times the average lag of their topic.

    Topics that cannot have one are dropped before the join, so only the few suspicious
    (snapshot, group, topic) triples meet their partition rows.
    """
    topics = lags.groupBy(*SNAPSHOT).agg(
        (F.sum("lag") / F.count(F.lit(1))).alias("average_lag"), F.max("lag").alias("_max")
    )
    suspects = topics.filter(F.col("_max") > F.col("average_lag") * factor).drop("_max")
    return (
        lags.filter("lag > 0")
        .join(suspects, SNAPSHOT)
        .filter(F.col("lag") > F.col("average_lag") * factor)
        .select(*SNAPSHOT, "partition", "lag", "average_lag")
    )


def problematic_lists(lags: DataFrame, factor: float = DEFAULTS.problem_factor) -> DataFrame:
    """Problematic partitions of each topic as a sorted array (fewer than 1/factor of them)."""
    return problematic_partitions(lags, factor).groupBy(*SNAPSHOT).agg(
        F.sort_array(F.collect_list("partition")).alias("problematic_partitions")
    )


def topic_details(lags: DataFrame, scored: DataFrame) -> DataFrame:
    """Nested view: scored topics with their partitions and problematic partitions as arrays.

    The arrays are as long as a topic has partitions at one snapshot.
    """
    nested = lags.groupBy(*SNAPSHOT).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "partition", "committed_offset", "log_end_offset", "lag", "last_commit_at", "is_stalled"
                )
            )
        ).alias("partitions")
    )
    factor = DEFAULTS.problem_factor
    problem = F.transform(
        F.filter(
            "partitions",
            lambda p: p["lag"] > F.col("total_lag") / F.greatest(F.size("partitions"), F.lit(1)) * factor,
        ),
        lambda p: p["partition"],
    )
    return scored.join(nested, SNAPSHOT).withColumn("problematic_partitions", problem)


# ---------------------------------------------------------------- groups and cycles


def group_rollup(scored: DataFrame) -> DataFrame:
    """One row per (snapshot, group): the highest topic score, and totals."""
    return scored.groupBy("snapshotted_at", "group_id").agg(
        F.max("severity_score").alias("severity_score"),
        F.count(F.lit(1)).alias("topic_count"),
        F.sum("total_lag").alias("total_lag"),
        F.count_if(F.col("total_lag") > 0).alias("lagging_topics"),
    )


def high_severity_groups(groups: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Groups that an analysis is made for."""
    return groups.filter(F.col("severity_score") >= cfg.high_score)


def worst_group_topic(scored: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """The worst group of each snapshot and its worst topic; names decide between equals.

    The smallest struct wins, so every task keeps one row per snapshot before the shuffle.
    The topic of the worst group with the highest score has the highest score of all.
    """
    pick = F.struct(
        (-F.col("severity_score")).alias("rank"),
        "group_id",
        "topic",
        "lag_classification",
        "total_lag",
        "lag_velocity_per_min",
        "severity_score",
    )
    return (
        scored.filter(F.col("severity_score") >= cfg.high_score)
        .groupBy("snapshotted_at")
        .agg(F.min(pick).alias("w"))
        .select(
            "snapshotted_at",
            "w.group_id",
            "w.topic",
            "w.lag_classification",
            "w.total_lag",
            "w.lag_velocity_per_min",
            "w.severity_score",
        )
    )


def cycles(groups: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """One row per snapshot: number of high groups and the highest score among them."""
    high = F.col("severity_score") >= cfg.high_score
    return groups.groupBy("snapshotted_at").agg(
        F.count_if(high).alias("high_groups"),
        F.coalesce(F.max(F.when(high, F.col("severity_score"))), F.lit(0.0)).alias("max_score"),
    )


def actionable_cycles(cycles_with_health: DataFrame) -> DataFrame:
    """Snapshots with a high group, or with unhealthy partitions."""
    return cycles_with_health.filter(
        (F.col("high_groups") > 0) | (F.col("under_replicated") > 0) | (F.col("offline") > 0)
    )


def cycle_severity(cycles_with_health: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Add the severity of the cycle: critical with unhealthy partitions, else by score."""
    unhealthy = (F.col("offline") > 0) | (F.col("under_replicated") > 0)
    return cycles_with_health.withColumn(
        "severity", F.when(unhealthy, "CRITICAL").otherwise(severity_label("max_score", cfg))
    )


# ---------------------------------------------------------------- behaviour over time


def lag_acceleration(with_v: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Change of velocity since the snapshot before, and the trend it stands for.

    A snapshot older than the history period does not count as the one before.
    """
    period = int(cfg.history_seconds * 1_000_000)

    def frames(w):
        past = w.rangeBetween(-period, -1)
        return {"previous_velocity": F.last("lag_velocity_per_min").over(past)}

    out = trailing(
        with_v, ["group_id", "topic"], "snapshotted_at", cfg.history_seconds, cfg.bucket_seconds, frames
    )
    v, p = F.col("lag_velocity_per_min"), F.col("previous_velocity")
    return out.withColumn("acceleration", v - p).withColumn(
        "trend",
        F.when(p.isNull(), "UNKNOWN")
        .when(v <= 0, "NOT_GROWING")
        .when(v >= p, "ACCELERATING")
        .otherwise("DECELERATING"),
    )


def lag_trend(topics: DataFrame, cfg: Thresholds = DEFAULTS, window_seconds: int = 600) -> DataFrame:
    """Least-squares slope of a topic's total lag, in messages per minute, over the snapshots of the
    last ``window_seconds`` (the snapshot itself included), and its change since the snapshot
    before within the history period.

    The slope is ``regr_slope`` over a range frame, so a trend of many samples is not one
    difference of two; fewer than two samples in the window give null. Each (group, topic) is cut
    in time slices first, so no key is one task.
    """
    span = int(window_seconds * 1_000_000)
    minutes = F.col("_us") / F.lit(60_000_000.0)

    def fitted(w):
        frame = w.rangeBetween(-span, 0)
        return {
            "lag_slope_per_min": F.regr_slope(F.col("total_lag").cast("double"), minutes).over(frame),
            "trend_points": F.count(F.lit(1)).over(frame),
        }

    keys = ["group_id", "topic"]
    out = trailing(topics, keys, "snapshotted_at", window_seconds, cfg.bucket_seconds, fitted)
    period = int(cfg.history_seconds * 1_000_000)

    def before(w):
        return {"previous_slope": F.last("lag_slope_per_min").over(w.rangeBetween(-period, -1))}

    out = trailing(out, keys, "snapshotted_at", cfg.history_seconds, cfg.bucket_seconds, before)
    return out.withColumn("slope_change", F.col("lag_slope_per_min") - F.col("previous_slope"))


def simultaneous_lag(with_v: DataFrame, min_groups: int = 2, min_topics: int = 2) -> DataFrame:
    """Snapshots at which several groups over several topics have rising lag."""
    return (
        with_v.filter("lag_velocity_per_min > 0")
        .groupBy("snapshotted_at")
        .agg(
            F.countDistinct("group_id").alias("rising_groups"),
            F.countDistinct("topic").alias("rising_topics"),
            F.sum("total_lag").alias("rising_lag"),
        )
        .filter((F.col("rising_groups") >= min_groups) & (F.col("rising_topics") >= min_topics))
    )


def catch_up(topics: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Minutes until a topic has no lag, from the rates since the snapshot before; null when
    the group is not catching up."""
    needed = topics.select(*SNAPSHOT, "total_lag", "committed_total", "log_end_total")
    out = previous(
        needed, ["group_id", "topic"], "snapshotted_at",
        ["snapshotted_at", "committed_total", "log_end_total"], cfg.bucket_seconds, cfg.shuffle_tasks,
    )
    minutes = (micros("snapshotted_at") - micros("prev_snapshotted_at")) / 60_000_000
    consumed = (F.col("committed_total") - F.col("prev_committed_total")) / minutes
    produced = (F.col("log_end_total") - F.col("prev_log_end_total")) / minutes
    gain = consumed - produced
    return out.filter("prev_snapshotted_at is not null").select(
        *SNAPSHOT,
        "total_lag",
        consumed.alias("consume_rate"),
        produced.alias("produce_rate"),
        F.when(gain > 0, F.try_divide(F.col("total_lag"), gain)).alias("catch_up_minutes"),
    )


def partition_increase_plan(
    partitions: DataFrame, keys: DataFrame, consumers: DataFrame
) -> DataFrame:
    """Advice per topic: consumers to run now, and a new partition count.

    ``partitions``: (topic, partition_count, replication_factor); ``keys``: one row per message
    with (topic, key); ``consumers``: (topic, consumers). The new count is twice the current
    one, raised to a multiple of the replication factor; more keys than that are needed.
    """
    cardinality = keys.groupBy("topic").agg(F.countDistinct("key").alias("key_count"))
    current, rf = F.col("partition_count"), F.greatest(F.col("replication_factor"), F.lit(1))
    new = (F.ceil(current * 2 / rf) * rf).cast("bigint")
    return (
        partitions.join(consumers, "topic", "left")
        .join(cardinality, "topic", "left")
        .select(
            "topic",
            current.alias("partition_count"),
            F.coalesce("consumers", F.lit(0)).cast("bigint").alias("consumers"),
            F.coalesce("key_count", F.lit(0)).cast("bigint").alias("key_count"),
            F.greatest(current - F.coalesce("consumers", F.lit(0)), F.lit(0))
            .cast("bigint").alias("consumers_to_add"),
            new.alias("new_partition_count"),
            (
                (F.coalesce("consumers", F.lit(0)) >= current)
                & (F.coalesce("key_count", F.lit(0)) > new)
            ).alias("increase_advised"),
        )
    )


def reset_impact(lags: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Offsets that a reset skips (positive) or replays (negative), per partition.

    ``targets`` has (group_id, target_at): reset to the end offset as of that time. Without it
    the reset is to the latest end. The committed offset is the newest one seen. Both lookups
    are one aggregation with a fixed-size buffer, so no partition history is gathered. The
    targets, one for each reset, go to every task: a shuffle by group would put all rows of a
    group into one.
    """
    if targets is None:
        joined = lags.withColumn("target_at", F.lit(None).cast("timestamp"))
        reached = F.lit(True)
    else:
        joined = lags.join(F.broadcast(targets), "group_id")
        reached = F.col("snapshotted_at") <= F.col("target_at")
    at = F.when(reached, F.col("snapshotted_at"))
    found = joined.groupBy(*SERIES, "target_at").agg(
        F.max_by("committed_offset", "snapshotted_at").alias("committed_offset"),
        F.max_by("log_end_offset", at).alias("_end"),
        F.min_by("log_end_offset", "snapshotted_at").alias("_earliest"),
    )
    end = F.coalesce("_end", "_earliest")
    return found.select(
        *SERIES,
        "target_at",
        "committed_offset",
        end.alias("target_offset"),
        (end - F.col("committed_offset")).alias("skipped_offsets"),
    )


def top_lag(lags: DataFrame, limit: int = 20) -> DataFrame:
    """The partition rows with the most lag over all groups, in order."""
    return (
        lags.select(*SNAPSHOT, "partition", "lag")
        .orderBy(F.desc("lag"), F.desc("snapshotted_at"), "group_id", "topic", "partition")
        .limit(limit)
    )
