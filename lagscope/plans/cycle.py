"""The whole lag cycle as one plan over all groups and snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..operators import dedup, health, lag, recommend
from ..session import store


@dataclass(frozen=True)
class Cycle:
    """Results of the lag cycle; all are DataFrames."""

    scored: DataFrame  # every (snapshot, group, topic)
    groups: DataFrame  # every (snapshot, group)
    cycles: DataFrame  # actionable snapshots with health and severity
    topics: DataFrame  # topics of the high groups of actionable snapshots
    recommendations: DataFrame  # ranked, per actionable snapshot
    find_worst: Callable[[], DataFrame]

    @cached_property
    def worst(self) -> DataFrame:
        """Worst group and topic per snapshot, without repeats; worked out when asked for."""
        return self.find_worst()


def scan_health(meta: DataFrame) -> DataFrame:
    """Counts and imbalance of each scan, in one row."""
    return health.scan_summary(meta)


def lag_cycle(
    snapshots: DataFrame,
    meta: DataFrame,
    cfg: Thresholds = DEFAULTS,
    cycle_seconds: int = 60,
    suppress_cycle: bool = False,
) -> Cycle:
    """Score, roll up, gate, de-duplicate and recommend.

    A worst topic seen again within the time to live has no new search made for it; with
    ``suppress_cycle`` its whole cycle is left out as well, even one with unhealthy partitions.
    """
    scored = store(lag.analyze_topics(snapshots, cfg), "scored")
    groups = lag.group_rollup(scored)
    checked = health.attach_health(lag.cycles(groups, cfg), scan_health(meta), cycle_seconds)
    actionable = store(lag.cycle_severity(lag.actionable_cycles(checked), cfg), "cycles")

    @cache
    def find_worst() -> DataFrame:
        return dedup.ttl_dedup(
            lag.worst_group_topic(scored, cfg),
            ["group_id", "lag_classification", "topic"],
            "snapshotted_at",
            cfg.dedup_ttl_seconds,
        )

    if suppress_cycle:
        fresh = find_worst().select("snapshotted_at")
        actionable = actionable.join(
            fresh.withColumn("_fresh", F.lit(True)), "snapshotted_at", "left"
        ).filter("_fresh or high_groups = 0").drop("_fresh")
    high = lag.high_severity_groups(groups, cfg).select(
        "snapshotted_at", "group_id", F.col("severity_score").alias("group_score")
    )
    # Topics without lag count in the roll-up and the velocity, but are not analysed.
    topics = scored.filter("total_lag > 0").join(high, ["snapshotted_at", "group_id"]).join(
        actionable.select("snapshotted_at"), "snapshotted_at", "left_semi"
    )
    recs = store(
        recommend.ranked_recs(
            store(recommend.heuristic_topic_recs(topics), "topic-recs"),
            recommend.heuristic_cluster_recs(actionable, cfg),
        ),
        "recommendations",
    )
    return Cycle(scored, groups, actionable, topics, recs, find_worst)


def hits_of_cycle(worst: DataFrame, hits: DataFrame) -> DataFrame:
    """Search results for the worst topic of each cycle. ``hits`` has a ``query_id`` that is the
    lag class searched for."""
    return worst.select("snapshotted_at", F.col("lag_classification").alias("query_id")).join(hits, "query_id")
