"""Series, counters and panels, and alerts that need a condition to last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.columns import micros
from ..functions.timeline import running_sum, runs, trailing
from .health import partition_health, topic_health


def lag_sum_series(lags: DataFrame) -> DataFrame:
    """Lag summed per group and topic over time."""
    return lags.groupBy(F.col("snapshotted_at").alias("ts"), "group_id", "topic").agg(
        F.sum("lag").alias("value")
    )


def lag_partition_series(lags: DataFrame) -> DataFrame:
    """Lag per partition over time."""
    return lags.select(
        F.col("snapshotted_at").alias("ts"), "group_id", "topic", "partition", F.col("lag").alias("value")
    )


def produce_rate(
    snapshots: DataFrame, range_seconds: int = 60, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Messages per second of each partition since the sample before, where that is at most
    ``range_seconds`` old. A falling offset counts from zero."""
    ends = snapshots.groupBy("topic", "partition", F.col("snapshotted_at").alias("ts")).agg(
        F.max("log_end_offset").alias("offset")
    )

    def frames(w):
        past = w.rangeBetween(-range_seconds * 1_000_000, -1)
        return {"_prev": F.last(F.struct("offset", "_us")).over(past), "_now": F.col("_us")}

    out = trailing(
        ends, ["topic", "partition"], "ts", range_seconds, cfg.bucket_seconds, frames
    ).filter("_prev is not null")
    grown = F.col("offset") - F.col("_prev.offset")
    increase = F.when(grown < 0, F.col("offset")).otherwise(grown)
    return out.select(
        "ts", "topic", "partition",
        (increase / ((F.col("_now") - F.col("_prev._us")) / 1_000_000)).alias("value"),
    )


def health_panel(meta: DataFrame, brokers: DataFrame) -> DataFrame:
    """Under-replicated and offline counts, brokers, and the colours of the two counts."""
    seen = brokers.groupBy("scan_at").agg(F.countDistinct("broker_id").alias("brokers"))

    def colour(name: str) -> Column:
        return F.when(F.col(name) >= 1, "red").otherwise("green")

    return partition_health(meta).join(seen, "scan_at", "left").select(
        "scan_at",
        "under_replicated",
        colour("under_replicated").alias("under_replicated_colour"),
        "offline",
        colour("offline").alias("offline_colour"),
        F.coalesce("brokers", F.lit(0).cast("bigint")).alias("brokers"),
    )


def counter(df: DataFrame, labels: Sequence[str], name: str = "total") -> DataFrame:
    """Number of rows per label set."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def running_counter(df: DataFrame, labels: Sequence[str], ts: str) -> DataFrame:
    """Value of the counter after each point in time. Rows are first counted per time; the
    running sum is made in year slices."""
    per_time = df.groupBy(*labels, ts).agg(F.count(F.lit(1)).alias("increments"))
    return running_sum(per_time, labels, ts, "increments", "total", 366 * 86_400)


def unhealthy_partitions(meta: DataFrame) -> DataFrame:
    """Gauge: the newest value of each kind of unhealthy partition."""
    return (
        partition_health(meta)
        .unpivot("scan_at", ["under_replicated", "offline"], "kind", "partitions")
        .groupBy("kind")
        .agg(
            F.max_by("partitions", "scan_at").alias("value"),
            F.max("scan_at").alias("updated_at"),
        )
    )


# ---------------------------------------------------------------- alerts


def alert_states(
    series: DataFrame,
    condition: Column,
    for_seconds: float,
    labels: Sequence[str],
    ts: str = "ts",
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """State of an alert at every sample: inactive, pending, or firing once the condition has
    held without a break for ``for_seconds``. ``active_since`` is the first sample of the
    unbroken stretch."""
    marked = series.withColumn("_active", F.coalesce(condition, F.lit(False)))
    out = runs(marked, list(labels), ts, "_active", cfg.bucket_seconds, cfg.shuffle_tasks)
    held = micros(ts) - micros("run_start")
    state = (
        F.when(~F.col("_active"), "inactive")
        .when(held >= int(for_seconds * 1_000_000), "firing")
        .otherwise("pending")
    )
    return out.select(
        *series.columns,
        F.when(F.col("_active"), F.col("run_start")).alias("active_since"),
        state.alias("state"),
    )


def firing(states: DataFrame, name: str, severity: str, summary: Column, description: Column | None = None) -> DataFrame:
    """Firing samples as alerts with name, severity and texts."""
    texts = [summary.alias("summary")]
    if description is not None:
        texts.append(description.alias("description"))
    return states.filter("state = 'firing'").select(
        "*", F.lit(name).alias("alert"), F.lit(severity).alias("severity"), *texts
    )


# Names, limits, durations and texts of the four alerts.
LAG_HIGH = ("KafkaConsumerLagHigh", 10_000, 300, "warning")
LAG_CRITICAL = ("KafkaConsumerLagCritical", 100_000, 120, "critical")
UNDER_REPLICATED = ("KafkaUnderReplicatedPartitions", 0, 60, "critical")
OFFLINE = ("KafkaOfflinePartitions", 0, 60, "critical")


def alert_lag_high(series: DataFrame, for_seconds: float = LAG_HIGH[2], cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Lag of a group on a topic is high."""
    name, limit, _, severity = LAG_HIGH
    states = alert_states(series, F.col("value") > limit, for_seconds, ["group_id", "topic"], cfg=cfg)
    return firing(
        states, name, severity,
        F.format_string("Consumer group %s lag is high on %s", "group_id", "topic"),
        F.format_string("Lag of %d messages on topic %s", F.col("value").cast("bigint"), "topic"),
    )


def alert_lag_critical(series: DataFrame, for_seconds: float = LAG_CRITICAL[2], cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Lag of a group on a topic is critical."""
    name, limit, _, severity = LAG_CRITICAL
    states = alert_states(series, F.col("value") > limit, for_seconds, ["group_id", "topic"], cfg=cfg)
    return firing(
        states, name, severity,
        F.format_string("CRITICAL: Consumer group %s lag on %s", "group_id", "topic"),
        F.format_string("Lag of %d messages — immediate action required", F.col("value").cast("bigint")),
    )


def alert_under_replicated(meta: DataFrame, for_seconds: float = UNDER_REPLICATED[2], cfg: Thresholds = DEFAULTS) -> DataFrame:
    """A topic has under-replicated partitions."""
    name, limit, _, severity = UNDER_REPLICATED
    series = topic_health(meta).select(
        F.col("scan_at").alias("ts"), "topic", F.col("under_replicated").alias("value")
    )
    states = alert_states(series, F.col("value") > limit, for_seconds, ["topic"], cfg=cfg)
    return firing(
        states, name, severity, F.format_string("Under-replicated partitions detected on %s", "topic")
    )


def alert_offline(meta: DataFrame, for_seconds: float = OFFLINE[2], cfg: Thresholds = DEFAULTS) -> DataFrame:
    """The cluster has offline partitions."""
    name, limit, _, severity = OFFLINE
    series = partition_health(meta).select(
        F.col("scan_at").alias("ts"), F.col("offline").alias("value")
    )
    states = alert_states(series, F.col("value") > limit, for_seconds, [], cfg=cfg)
    return firing(states, name, severity, F.lit("Offline Kafka partitions detected"))


def lag_escalations(topics_with_velocity: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Topics whose lag has been above the limit and growing for the whole period."""
    rising = (F.col("total_lag") > cfg.escalation_lag) & (F.col("lag_velocity_per_min") > 0)
    needed = topics_with_velocity.select(
        "snapshotted_at", "group_id", "topic", "total_lag", "lag_velocity_per_min"
    )
    return alert_states(
        needed, rising, cfg.escalation_seconds, ["group_id", "topic"],
        ts="snapshotted_at", cfg=cfg,
    ).filter("state = 'firing'")


def messages_per_window(
    records: DataFrame, ts: str = "timestamp", window: str = "1 minute", slide: str | None = None
) -> DataFrame:
    """Messages per topic in tumbling windows, or in sliding ones where ``slide`` is given."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        records.groupBy(w.alias("w"), "topic")
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(F.col("w.start").alias("window_start"), "topic", "messages")
    )
