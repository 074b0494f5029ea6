"""Partition and broker health from cluster scans, and traffic skew from offset snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, SCAN_EXCLUDED_PREFIXES, Thresholds
from ..functions.columns import micros, no_prefix
from ..functions.timeline import previous


def visible_partitions(
    meta: DataFrame, exclude_prefixes: Sequence[str] = SCAN_EXCLUDED_PREFIXES
) -> DataFrame:
    """Partitions of topics that are scanned, marked as offline or short of replicas."""
    offline = F.col("leader") == -1
    return meta.filter(no_prefix("topic", exclude_prefixes)).select(
        "*",
        offline.alias("is_offline"),
        (~offline & (F.size("isrs") < F.size("replicas"))).alias("is_under_replicated"),
    )


def partition_health(meta: DataFrame) -> DataFrame:
    """Partition counts of each scan. Offline partitions are not counted as under-replicated."""
    return (
        visible_partitions(meta)
        .groupBy("scan_at")
        .agg(
            F.count(F.lit(1)).alias("total_partitions"),
            F.count_if("is_offline").alias("offline"),
            F.count_if("is_under_replicated").alias("under_replicated"),
        )
    )


def topic_health(meta: DataFrame) -> DataFrame:
    """The same counts per scan and topic."""
    return (
        visible_partitions(meta)
        .groupBy("scan_at", "topic")
        .agg(
            F.count(F.lit(1)).alias("total_partitions"),
            F.count_if("is_offline").alias("offline"),
            F.count_if("is_under_replicated").alias("under_replicated"),
        )
    )


def broker_leader_counts(meta: DataFrame) -> DataFrame:
    """Partitions led by each broker, per scan."""
    return (
        visible_partitions(meta)
        .filter("not is_offline")
        .groupBy("scan_at", F.col("leader").alias("broker_id"))
        .agg(F.count(F.lit(1)).alias("leader_count"))
    )


def leader_imbalance(meta: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Largest share of leaders on one broker, per scan; zero where no partition has a leader."""
    counts = (
        visible_partitions(meta)
        .groupBy("scan_at", "leader")
        .agg(F.count_if(~F.col("is_offline")).alias("n"))
    )
    share = F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0))
    return (
        counts.groupBy("scan_at")
        .agg(share.alias("leader_imbalance"))
        .withColumn("is_imbalanced", F.col("leader_imbalance") > cfg.imbalance_share)
    )


def scan_summary(meta: DataFrame, cfg: Thresholds = DEFAULTS, brokers: bool = False) -> DataFrame:
    """Counts and imbalance of each scan, from one read of the table: first by (scan, leader), then
    by scan. ``brokers`` adds the leaders per broker as a map."""
    per_leader = (
        visible_partitions(meta)
        .groupBy("scan_at", "leader")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("is_offline").alias("off"),
            F.count_if("is_under_replicated").alias("short"),
        )
    )
    led = F.col("n") - F.col("off")
    columns = [
        F.sum("n").alias("total_partitions"),
        F.sum("off").alias("offline"),
        F.sum("short").alias("under_replicated"),
        F.coalesce(F.try_divide(F.max(led), F.sum(led)), F.lit(0.0)).alias("leader_imbalance"),
    ]
    if brokers:
        entry = F.when(led > 0, F.struct(F.col("leader").alias("broker_id"), led.alias("leader_count")))
        columns.append(F.sort_array(F.collect_list(entry)).alias("_leaders"))
    out = per_leader.groupBy("scan_at").agg(*columns)
    if brokers:
        filled = F.when(F.size("_leaders") > 0, F.map_from_entries("_leaders"))
        out = out.withColumn("broker_partition_counts", filled).drop("_leaders")
    return out


def health_summary(meta: DataFrame, hotspots: DataFrame | None = None) -> DataFrame:
    """One row per scan: counts, imbalance, and leaders per broker as a map.

    The map has one entry per broker. ``hotspots`` (from ``partition_hotspots``, renamed to
    ``scan_at``) adds them as an array.
    """
    out = scan_summary(meta, brokers=True)
    if hotspots is not None:
        listed = hotspots.groupBy("scan_at").agg(
            F.sort_array(
                F.collect_list(F.struct("topic", "partition", "message_rate", "skew_factor"))
            ).alias("hotspot_partitions")
        )
        out = out.join(listed, "scan_at", "left")
    return out


def attach_health(cycles: DataFrame, health: DataFrame, cycle_seconds: int = 60) -> DataFrame:
    """Health of the scan made in each cycle; cycles without a scan get zeros."""

    def cell(ts):
        return F.expr(f"unix_micros(`{ts}`) div {cycle_seconds * 1_000_000}")

    scans = health.withColumn("_cell", cell("scan_at"))
    counts = [c for c in health.columns if c != "scan_at"]
    latest = scans.groupBy("_cell").agg(F.max_by(F.struct(*counts), "scan_at").alias("_h"))
    return (
        cycles.withColumn("_cell", cell("snapshotted_at"))
        .join(latest, "_cell", "left")
        .select(
            *cycles.columns,
            *[F.coalesce(F.col(f"_h.{c}"), F.lit(0)).alias(c) for c in counts],
        )
    )


# ---------------------------------------------------------------- traffic


def partition_rates(snapshots: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Messages per minute of each partition since the snapshot before.

    End offsets are the same for all groups, so one row per (topic, partition, time) is kept.
    A falling offset means the log was made anew; what it holds now is the increase.
    """
    ends = (
        snapshots.filter(no_prefix("topic", SCAN_EXCLUDED_PREFIXES))
        .groupBy("topic", "partition", "snapshotted_at")
        .agg(F.max("log_end_offset").alias("log_end_offset"))
    )
    paired = previous(
        ends, ["topic", "partition"], "snapshotted_at",
        ["log_end_offset", "snapshotted_at"], cfg.bucket_seconds, cfg.shuffle_tasks,
    ).filter("prev_snapshotted_at is not null")
    grown = F.col("log_end_offset") - F.col("prev_log_end_offset")
    increase = F.when(grown < 0, F.col("log_end_offset")).otherwise(grown)
    minutes = (micros("snapshotted_at") - micros("prev_snapshotted_at")) / 60_000_000
    return paired.select(
        "snapshotted_at",
        "topic",
        "partition",
        increase.alias("increase"),
        (increase / minutes).alias("message_rate"),
    )


def _with_share(rates: DataFrame) -> DataFrame:
    totals = rates.groupBy("snapshotted_at", "topic").agg(
        F.sum("increase").alias("topic_increase"),
        F.count(F.lit(1)).alias("partition_count"),
        F.max("increase").alias("top_increase"),
    )
    return rates.join(totals, ["snapshotted_at", "topic"])


def partition_hotspots(rates: DataFrame, factor: float = DEFAULTS.hotspot_factor) -> DataFrame:
    """Partitions that carry more than ``factor`` times their fair share of a topic."""
    skew = (
        F.col("increase") * F.col("partition_count") / F.col("topic_increase")
    )
    return (
        _with_share(rates)
        .filter("partition_count >= 2 and topic_increase > 0")
        .select("snapshotted_at", "topic", "partition", "message_rate", skew.alias("skew_factor"))
        .filter(F.col("skew_factor") > factor)
    )


def hotspot_cleared(
    rates: DataFrame, hotspots: DataFrame, factor: float = DEFAULTS.hotspot_cleared_factor
) -> DataFrame:
    """For each partition that was ever hot: whether its newest rate is within ``factor`` times
    the average of its topic."""
    hot = hotspots.groupBy("topic", "partition").agg(F.max("snapshotted_at").alias("last_hot_at"))
    newest = (
        _with_share(rates)
        .groupBy("topic", "partition")
        .agg(
            F.max("snapshotted_at").alias("checked_at"),
            F.max_by(
                F.col("increase") * F.col("partition_count") <= F.col("topic_increase") * factor,
                "snapshotted_at",
            ).alias("is_cleared"),
        )
    )
    return hot.join(newest, ["topic", "partition"])


def _local_tops(keep: int, key_type: str):
    """Each task's own key counts per partition: its ``keep`` most frequent keys, and one row with
    a null key and the count of the next one, which no key the task left out exceeds."""

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        counts = pd.concat(parts).groupby(["topic", "partition", "key"], dropna=False).size().rename("n").reset_index()
        counts = counts.sort_values(["topic", "partition", "n", "key"], ascending=[True, True, False, True], kind="stable")
        place = counts.groupby(["topic", "partition"]).cumcount()
        top = counts[place < keep].assign(left=False)
        rest = counts[place == keep].assign(key=None, left=True)
        yield pd.concat([top, rest])[["topic", "partition", "key", "n", "left"]]

    return tops, f"topic string, partition int, key {key_type}, n long, left boolean"


def hot_keys(records: DataFrame, hotspots: DataFrame, k: int = 10, keep: int | None = None) -> DataFrame:
    """The ``k`` most frequent keys of every partition that was hot, exact.

    Each task hands on only its ``keep`` (default ``8 k``) most frequent keys of a partition and
    the count of its next key; a key that no task handed on has at most the sum of those counts.
    The handed-on keys are counted exactly; where the k-th of them is above that sum the result is
    exact, and only the other partitions are counted key by key. So the shuffle grows with tasks
    times ``keep``, not with the keys, in any partition where a few keys stand out.
    """
    hot = hotspots.select("topic", "partition").distinct()
    rows = records.join(hot, ["topic", "partition"], "left_semi").select("topic", "partition", "key")
    tops, schema = _local_tops(keep or 8 * k, rows.schema["key"].dataType.simpleString())
    sketch = rows.mapInPandas(tops, schema)
    limit = sketch.where("left").groupBy("topic", "partition").agg(F.sum("n").alias("unseen"))
    named = sketch.where("NOT left").select("topic", "partition", "key").distinct()
    order = Window.partitionBy("topic", "partition").orderBy(F.desc("messages"), "key")

    def ranked(counts: DataFrame) -> DataFrame:
        return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)

    same = (rows["topic"] == named["topic"]) & (rows["partition"] == named["partition"]) & rows["key"].eqNullSafe(named["key"])
    exact = ranked(rows.join(named, same, "left_semi").groupBy("topic", "partition", "key").agg(F.count(F.lit(1)).alias("messages")))
    kth = exact.groupBy("topic", "partition").agg(F.count("*").alias("found"), F.min("messages").alias("least"))
    sure = kth.join(limit, ["topic", "partition"], "left").where(
        F.col("unseen").isNull() | ((F.col("found") == k) & (F.col("least") > F.col("unseen")))
    ).select("topic", "partition")
    unsure = hot.join(sure, ["topic", "partition"], "left_anti")
    whole = ranked(
        rows.join(unsure, ["topic", "partition"], "left_semi").groupBy("topic", "partition", "key").agg(F.count(F.lit(1)).alias("messages"))
    )
    return exact.join(sure, ["topic", "partition"], "left_semi").unionByName(whole)


# ---------------------------------------------------------------- replicas and leaders


def lagging_brokers(meta: DataFrame) -> DataFrame:
    """Brokers missing from the in-sync set, with the number of partitions, per scan."""
    return (
        visible_partitions(meta)
        .select("scan_at", F.explode(F.array_except("replicas", "isrs")).alias("broker_id"))
        .groupBy("scan_at", "broker_id")
        .agg(F.count(F.lit(1)).alias("out_of_sync_partitions"))
    )


def leader_fair_share(
    meta: DataFrame,
    tolerance: float = DEFAULTS.fair_share_tolerance,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Leaders per broker against an equal split over the brokers that lead or replicate."""
    visible = visible_partitions(meta)
    sides = visible.select(
        "scan_at",
        F.explode(F.concat(F.array_distinct("replicas"), F.array("leader"))).alias("broker_id"),
        F.lit(0).alias("leads"),
    ).filter("broker_id >= 0")
    leads = visible.filter("not is_offline").select(
        "scan_at", F.col("leader").alias("broker_id"), F.lit(1).alias("leads")
    )
    per_broker = (
        sides.unionByName(leads).groupBy("scan_at", "broker_id").agg(F.sum("leads").alias("leader_count"))
    )
    totals = per_broker.groupBy("scan_at").agg(
        F.sum("leader_count").alias("_leaders"), F.count(F.lit(1)).alias("_brokers")
    )
    fair = F.try_divide(F.col("_leaders"), F.col("_brokers"))
    return per_broker.join(totals, "scan_at").select(
        "scan_at",
        "broker_id",
        "leader_count",
        fair.alias("fair_share"),
        (F.col("leader_count") > fair * (1 + tolerance)).alias("above_fair_share"),
        F.coalesce(
            F.try_divide(F.col("leader_count"), F.col("_leaders")) > cfg.imbalance_share, F.lit(False)
        ).alias("above_imbalance_share"),
    )


def non_preferred_leaders(meta: DataFrame) -> DataFrame:
    """Partitions led by another broker than their first replica."""
    return (
        visible_partitions(meta)
        .filter((~F.col("is_offline")) & (F.col("leader") != F.col("replicas")[0]))
        .select("scan_at", "topic", "partition", "leader", F.col("replicas")[0].alias("preferred_leader"))
    )
