"""Cluster configuration snapshots and what changed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SCAN_EXCLUDED_PREFIXES
from ..functions.columns import no_prefix
from ..functions.timeline import previous

YEAR_SECONDS = 366 * 86_400


def config_snapshot(meta: DataFrame, brokers: DataFrame) -> DataFrame:
    """Topics with partition count and replication factor, and the broker count, per scan.

    The replication factor is the replica count of the first partition, and 1 without one.
    """
    topics = (
        meta.filter(no_prefix("topic", SCAN_EXCLUDED_PREFIXES))
        .groupBy(F.col("scan_at").alias("snapshot_at"), "topic")
        .agg(
            F.count("partition").alias("partition_count"),
            F.min_by(F.size("replicas"), "partition").alias("_rf"),
        )
        .withColumn("replication_factor", F.coalesce("_rf", F.lit(1)))
        .drop("_rf")
    )
    counted = brokers.groupBy(F.col("scan_at").alias("snapshot_at")).agg(
        F.countDistinct("broker_id").alias("broker_count")
    )
    return topics.join(counted, "snapshot_at", "left").select(
        "snapshot_at",
        F.coalesce("broker_count", F.lit(0).cast("bigint")).alias("broker_count"),
        "topic",
        "partition_count",
        "replication_factor",
    )


def snapshot_pairs(snaps: DataFrame) -> DataFrame:
    """Each snapshot with the one before it: one row per snapshot, found in year slices so that
    no task sees the whole history."""
    each = snaps.groupBy("snapshot_at").agg(
        F.max("broker_count").alias("broker_count"), F.count("topic").alias("topic_count")
    )
    return previous(each, [], "snapshot_at", ["snapshot_at", "broker_count"], YEAR_SECONDS)


def config_delta_brokers(snaps: DataFrame) -> DataFrame:
    """Snapshots whose broker count differs from the one before."""
    return (
        snapshot_pairs(snaps)
        .filter("prev_broker_count is not null and prev_broker_count <> broker_count")
        .select(
            "snapshot_at",
            F.col("prev_broker_count").alias("brokers_before"),
            F.col("broker_count").alias("brokers_after"),
        )
    )


def config_delta_topics(snaps: DataFrame) -> DataFrame:
    """Topics that are new, removed or changed against the snapshot before."""
    pairs = snapshot_pairs(snaps).filter("prev_snapshot_at is not null")
    shape = ["partition_count", "replication_factor"]
    after = snaps.join(pairs.select("snapshot_at"), "snapshot_at", "left_semi").select(
        "snapshot_at", "topic", *[F.col(c).alias(f"{c}_after") for c in shape], F.lit(True).alias("_a")
    )
    before = snaps.withColumnRenamed("snapshot_at", "prev_snapshot_at").join(
        pairs.select("prev_snapshot_at", "snapshot_at"), "prev_snapshot_at"
    ).select(
        "snapshot_at", "topic", *[F.col(c).alias(f"{c}_before") for c in shape], F.lit(True).alias("_b")
    )
    changed = (F.col("partition_count_before") != F.col("partition_count_after")) | (
        F.col("replication_factor_before") != F.col("replication_factor_after")
    )
    return (
        after.join(before, ["snapshot_at", "topic"], "full_outer")
        .withColumn(
            "change",
            F.when(F.col("_b").isNull(), "NEW")
            .when(F.col("_a").isNull(), "REMOVED")
            .when(changed, "CHANGED"),
        )
        .filter("change is not null")
        .select(
            "snapshot_at",
            "topic",
            "change",
            "partition_count_before",
            "partition_count_after",
            "replication_factor_before",
            "replication_factor_after",
        )
    )


def config_delta_summary(snaps: DataFrame) -> DataFrame:
    """One row per snapshot: counts, whether anything changed, and the change as JSON.

    The JSON lists topics by name; it is as long as the list of changed topics.
    """
    each = snapshot_pairs(snaps)
    topics = config_delta_topics(snaps)

    def names(kind: str):
        listed = F.sort_array(F.collect_list(F.when(F.col("change") == kind, F.col("topic"))))
        return F.when(F.size(listed) > 0, listed)

    changed = F.sort_array(
        F.collect_list(
            F.when(
                F.col("change") == "CHANGED",
                F.struct(
                    "topic",
                    F.struct(
                        F.col("topic").alias("name"),
                        F.col("partition_count_before").alias("partition_count"),
                        F.col("replication_factor_before").alias("replication_factor"),
                    ).alias("before"),
                    F.struct(
                        F.col("topic").alias("name"),
                        F.col("partition_count_after").alias("partition_count"),
                        F.col("replication_factor_after").alias("replication_factor"),
                    ).alias("after"),
                ),
            )
        )
    )
    per_snapshot = topics.groupBy("snapshot_at").agg(
        F.when(F.size(changed) > 0, changed).alias("changed_topics"),
        names("NEW").alias("new_topics"),
        names("REMOVED").alias("removed_topics"),
    )
    brokers = F.when(
        F.col("prev_broker_count").isNotNull() & (F.col("prev_broker_count") != F.col("broker_count")),
        F.struct(F.col("prev_broker_count").alias("before"), F.col("broker_count").alias("after")),
    )
    delta = F.struct(
        brokers.alias("broker_count"), "changed_topics", "new_topics", "removed_topics"
    )
    joined = each.join(per_snapshot, "snapshot_at", "left")
    has = (
        brokers.isNotNull()
        | F.col("changed_topics").isNotNull()
        | F.col("new_topics").isNotNull()
        | F.col("removed_topics").isNotNull()
    )
    return joined.select(
        "snapshot_at",
        "broker_count",
        "topic_count",
        has.alias("has_delta"),
        F.when(has, F.to_json(delta)).alias("change_delta"),
    )


def config_table(snaps: DataFrame) -> DataFrame:
    """Stored form of the snapshots: topics as a JSON array, delta as JSON."""
    topics = snaps.groupBy("snapshot_at").agg(
        F.to_json(
            F.sort_array(
                F.collect_list(
                    F.struct(F.col("topic").alias("name"), "partition_count", "replication_factor")
                )
            )
        ).alias("topics")
    )
    return config_delta_summary(snaps).join(topics, "snapshot_at").select(
        "snapshot_at", "broker_count", "topics", "change_delta"
    )


def newest_snapshots(snaps: DataFrame, count: int) -> DataFrame:
    """Rows of the newest ``count`` snapshots and of the one before them, which they are compared
    with. A report of a few snapshots works on these rows and not on the whole history."""
    newest = snaps.select("snapshot_at").distinct().orderBy(F.desc("snapshot_at")).limit(count + 1)
    return snaps.join(F.broadcast(newest), "snapshot_at", "left_semi")
