"""Writing results: append, insert-once, upsert, audit rows and published events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANALYSIS_TOPIC, RECOMMENDATION_TOPIC
from ..session import tasks_for


def append_snapshots(snapshots: DataFrame, path: str, files_per_day: int = 8) -> None:
    """Append offset snapshots, one folder per day, sorted so that readers can skip. Rows of a
    day go to at most ``files_per_day`` tasks, by group and topic."""
    part = F.pmod(F.xxhash64("group_id", "topic"), F.lit(files_per_day))
    (
        snapshots.withColumn("snapshot_date", F.to_date("snapshotted_at"))
        .repartition("snapshot_date", part)
        .sortWithinPartitions("snapshot_date", "group_id", "topic", "snapshotted_at")
        .write.mode("append")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def insert_ignore(
    new: DataFrame, existing: DataFrame, keys: str | Sequence[str], order: Sequence[str],
    size: int | None = None,
) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; the first by ``order`` of each key.

    ``size`` is the number of rows of ``new``, where known: rows are dealt by key to as many tasks
    as they ask for, and the join and the aggregation sort them there.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    tasks = tasks_for(new.sparkSession, size) if size is not None else None
    if tasks:
        new, existing = (t.repartition(tasks, *keys) for t in (new, existing))
    fresh = new.join(existing.select(*keys), keys, "left_anti")
    others = [c for c in new.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    )
    return first.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in new.columns])


def vector_upsert(stored: DataFrame, new: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The collection after writing ``new``: per id the row with the highest version, the new
    one where versions are equal. One aggregation; every task keeps one row per id."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in stored.columns if c != key]), F.struct(version, "_new")).alias("r")
    )
    return last.select(*[F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in stored.columns])


def audit_rows(
    df: DataFrame,
    event_type: str,
    payload: Sequence[str],
    logged_at: str,
    group: str | None = None,
    topic: str | None = None,
) -> DataFrame:
    """Audit rows with the named columns as JSON payload."""
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(event_type).alias("event_type"),
        (F.col(group) if group else none).alias("consumer_group"),
        (F.col(topic) if topic else none).alias("topic"),
        F.to_json(F.struct(*payload)).alias("payload"),
        F.col(logged_at).alias("logged_at"),
    )


def publish_routes(events: DataFrame, key: str = "analysis_id", recommendations: str = "recommendations") -> DataFrame:
    """Messages to publish: every event on the analysis route, and those with recommendations
    also on the recommendation route. One pass over the events."""
    routes = F.when(
        F.size(recommendations) > 0, F.array(F.lit(ANALYSIS_TOPIC), F.lit(RECOMMENDATION_TOPIC))
    ).otherwise(F.array(F.lit(ANALYSIS_TOPIC)))
    return events.select(
        F.explode(routes).alias("topic"),
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*events.columns)).alias("value"),
    )


def with_reference_ids(events: DataFrame) -> DataFrame:
    """Add the ids of the incidents and runbooks that each event refers to, where it has them."""
    for source, field, name in (
        ("similar_incidents", "incident_id", "similar_incident_ids"),
        ("runbook_references", "runbook_id", "runbook_reference_ids"),
    ):
        if source in events.columns:
            events = events.withColumn(name, F.col(f"{source}.{field}"))
    return events
