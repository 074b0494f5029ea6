"""The read side: newest rows first, with optional filters.

Every query filters and projects before it sorts, so Parquet readers get the filter and the
columns, and sort plus limit becomes a top-n per task. Ties on time are settled by a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iso_time

# A result of at most this many short rows is sent to all tasks.
BROADCAST_ROWS = 10_000


def list_analyses(analyses: DataFrame, limit: int = 20, severity: str | None = None) -> DataFrame:
    """Newest analyses, of one severity where that is given."""
    rows = analyses if not severity else analyses.filter(F.col("severity") == severity.upper())
    return (
        rows.orderBy(F.desc("analyzed_at"), "analysis_id")
        .limit(limit)
        .select(
            "analysis_id",
            "triggered_by",
            iso_time(F.col("analyzed_at")).alias("analyzed_at"),
            "severity",
            F.col("overall_confidence").alias("confidence"),
            F.col("llm_root_cause_summary").alias("summary"),
        )
    )


def get_analysis(analyses: DataFrame, analysis_id: str) -> DataFrame:
    """One analysis by its id; no row where it does not exist."""
    return analyses.filter(F.col("analysis_id") == analysis_id)


def consumer_group_lag(
    snapshots: DataFrame, group_id: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest lag rows, of one group where that is given. Lag is the stored, raw one."""
    rows = snapshots if not group_id else snapshots.filter(F.col("group_id") == group_id)
    return (
        rows.orderBy(F.desc("snapshotted_at"), "group_id", "topic", "partition")
        .limit(limit)
        .select(
            "group_id",
            "topic",
            "partition",
            (F.col("log_end_offset") - F.col("committed_offset")).alias("lag"),
            iso_time(F.col("snapshotted_at")).alias("snapshotted_at"),
        )
    )


def list_recommendations(
    recommendations: DataFrame,
    analyses: DataFrame,
    applied: bool | None = None,
    limit: int = 50,
) -> DataFrame:
    """Newest recommendations with severity and time of their analysis.

    Only ids meet in the large join. The newest ``limit`` analyses that have a recommendation
    are enough for ``limit`` rows, and so few that they can be sent to the recommendations.
    """
    rows = recommendations
    if applied is not None:
        rows = rows.filter(F.coalesce("applied", F.lit(False)) == F.lit(applied))
    newest = (
        analyses.select("analysis_id", "severity", "analyzed_at")
        .join(rows.select("analysis_id"), "analysis_id", "left_semi")
        .orderBy(F.desc("analyzed_at"), "analysis_id")
        .limit(limit)
    )
    if limit <= BROADCAST_ROWS:
        newest = F.broadcast(newest)
    return (
        rows.join(newest, "analysis_id")
        .orderBy(F.desc("analyzed_at"), "analysis_id", "ordinal", "recommendation_id")
        .limit(limit)
    )


def list_cluster_configs(configs: DataFrame, limit: int = 10) -> DataFrame:
    """Newest configuration snapshots with the number of topics and the change, if any."""
    return (
        configs.orderBy(F.desc("snapshot_at"))
        .limit(limit)
        .select(
            iso_time(F.col("snapshot_at")).alias("snapshot_at"),
            "broker_count",
            F.json_array_length("topics").alias("topic_count"),
            F.col("change_delta").isNotNull().alias("has_changes"),
            "change_delta",
        )
    )


def audit_log(audit: DataFrame, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """Newest audit rows, of one type where that is given."""
    rows = audit if not event_type else audit.filter(F.col("event_type") == event_type.upper())
    return (
        rows.orderBy(F.desc("logged_at"), "id")
        .limit(limit)
        .select(
            "event_type", "consumer_group", "topic", "payload",
            iso_time(F.col("logged_at")).alias("logged_at"),
        )
    )
