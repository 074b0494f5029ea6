"""Structured Streaming forms of the operators whose result depends on what came before.

Everything here takes and returns streaming DataFrames; ``start_*`` functions write them. Rows
later than the watermark are dropped, and counted by ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..config import DEFAULTS, Thresholds
from ..operators import config_history, lag, metrics
from ..sources import sinks
from .ordered import in_event_order

TOPIC_COLUMNS = [
    "total_lag", "total_lag_raw", "partition_rows", "lagging_partitions", "stalled_count", "max_lag"
]


def lag_totals(snapshots: DataFrame, delay: str = "2 minutes", cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Topic totals of each poll, out once the watermark has passed the poll."""
    return lag.topic_lag(lag.lag_by_partition(snapshots.withWatermark("snapshotted_at", delay), cfg=cfg))


def velocity(topics: DataFrame, delay: str = "2 minutes", cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Lag velocity of a stream of topic totals; the state is the history inside the period.

    Same rows as ``operators.lag.with_velocity``, which defines the result.
    """
    period = int(cfg.history_seconds * 1_000_000)
    shortest = cfg.min_elapsed_seconds * 1_000_000

    def step(memory, row):
        t, total, raw, partitions = row[:4]
        kept = [memory[i : i + 3] for i in range(0, len(memory), 3)]
        kept = [m for m in kept if m[0] > t - period]
        past = [m for m in kept if m[0] < t]
        speed = 0.0
        if total > 0 and sum(m[2] for m in past) >= 2 and t - past[0][0] >= shortest:
            speed = (total - past[0][1]) / ((t - past[0][0]) / 60_000_000)
        if row[4] > 0 or not cfg.drop_zero_lag_history:
            kept.append([t, raw, partitions])
        return [v for m in kept for v in m], (speed,)

    return in_event_order(
        _marked(topics, "snapshotted_at", delay),
        ["group_id", "topic"],
        "snapshotted_at",
        TOPIC_COLUMNS,
        T.StructType([T.StructField("lag_velocity_per_min", T.DoubleType())]),
        step,
        lambda memory: memory[-3] + period if memory else None,
    )


def analyze_topics(topics: DataFrame, delay: str = "2 minutes", cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Topic totals to classified and scored topics, as a stream.

    A stream cannot go from an aggregation into keyed state, so ``lag_totals`` is written to a
    table (``start_table``) and ``topics`` is a stream over that table.
    """
    return lag.score(lag.classify(velocity(topics, delay, cfg), cfg), cfg)


def alert_states(
    series: DataFrame,
    condition: Column,
    for_seconds: float,
    labels: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    delay: str = "2 minutes",
) -> DataFrame:
    """States of an alert over a stream of samples; same rows as ``metrics.alert_states``."""
    hold = int(for_seconds * 1_000_000)
    marked = _marked(series, ts, delay).withColumn(
        "_active", F.coalesce(condition, F.lit(False)).cast("bigint")
    )

    def step(memory, row):
        if not row[2]:
            return [], (None, "inactive")
        since = memory[0] if memory else row[0]
        return [since], (since, "firing" if row[0] - since >= hold else "pending")

    out = in_event_order(
        marked, labels, ts, [value, "_active"],
        T.StructType([T.StructField("_since", T.LongType()), T.StructField("state", T.StringType())]),
        step,
        lambda memory: 2**62 if memory else None,
    )
    return out.select(
        *labels, ts, value, F.timestamp_micros("_since").alias("active_since"), "state"
    )


def ttl_dedup(
    hits: DataFrame, keys: Sequence[str], ts: str, ttl_seconds: int = 600, delay: str = "2 minutes"
) -> DataFrame:
    """Hits that pass; same rows as ``dedup.ttl_dedup``. The state of a key is the time of its
    last pass, and is forgotten when the silence is over."""
    ttl = ttl_seconds * 1_000_000

    def step(memory, row):
        if memory and row[0] < memory[0] + ttl:
            return memory, None
        return [row[0]], ()

    return in_event_order(
        _marked(hits, ts, delay), keys, ts, [], T.StructType([]), step,
        lambda memory: memory[0] + ttl if memory else None,
    )


def _marked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with a watermark on ``ts``. A mark left in the schema by another stream that
    wrote the table means nothing here and is taken off."""
    plain = stream.select(*[F.col(c).alias(c, metadata={}) if c == ts else F.col(c) for c in stream.columns])
    return plain.withWatermark(ts, delay)


def messages_per_window(
    records: DataFrame, ts: str = "timestamp", window: str = "1 minute",
    slide: str | None = None, delay: str = "2 minutes",
) -> DataFrame:
    """Messages per topic and window, out once the watermark has passed the window."""
    return metrics.messages_per_window(records.withWatermark(ts, delay), ts, window, slide)


# ---------------------------------------------------------------- sinks


def start_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append a stream to a Parquet table, exactly once."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )


def start_analysis_sinks(
    events: DataFrame, analyses: str, recommendations: str, audit: str, routes: str, checkpoint: str
) -> DataStreamWriter:
    """Write each batch of analysis events to three tables and the published messages.

    A batch that is run again after a failure overwrites its own folder, so every table gets it
    once. Events that come twice, in one batch or in several, are stored once by their id. The
    stored analyses also have the ids of the incidents and runbooks they refer to; there is one
    audit row for each analysis, with the recommendations of all its parts.
    """
    fields = events.schema["recommendations"].dataType.elementType.names
    keys = [k for k in ("analysis_id", "part") if k in events.columns]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            stored = _earlier(spark, analyses, number)
            if stored is None:
                stored = batch.limit(0)
            else:
                # An id stands for one point in time, so older files cannot hold it.
                start = batch.agg(F.min("analyzed_at")).first()[0]
                stored = stored.filter(F.col("analyzed_at") >= F.lit(start))
            new = sinks.insert_ignore(batch, stored, keys, ["analyzed_at"], size=batch.count())
            _write(sinks.with_reference_ids(new), analyses, number)
            mine = spark.read.parquet(f"{analyses}/batch={number}")
            listed = mine.select("analysis_id", F.col("analyzed_at").alias("created_at"), F.posexplode("recommendations").alias("_place", "r"))
            place = [] if "ordinal" in fields else [F.col("_place").alias("ordinal")]
            _write(
                listed.select("analysis_id", *place, "r.*", F.lit(False).alias("applied"), "created_at"),
                recommendations, number,
            )
            counted = mine.groupBy("analysis_id", "severity", "analyzed_at").agg(
                F.sum(F.size("recommendations")).alias("recommendation_count")
            )
            _write(
                sinks.audit_rows(
                    counted, "LAG_ANALYSIS_COMPLETED",
                    ["analysis_id", "severity", "recommendation_count"], "analyzed_at",
                ),
                audit, number,
            )
            _write(sinks.publish_routes(mine.select(*events.columns)), routes, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _write(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _earlier(spark, path: str, number: int) -> DataFrame | None:
    try:
        table = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return table.filter(F.col("batch") < number)


def start_config_changes(
    snapshots: DataFrame, stored: str, changes: str, checkpoint: str, delay: str = "1 hour", brokers: str | None = None
) -> DataStreamWriter:
    """Compare configuration snapshots with the ones before them and write what changed.

    A snapshot may come in several files and batches, and snapshots may come out of order within
    ``delay``: rows are stored as they come, and a snapshot is compared once rows that are more
    than ``delay`` later have come, so it is whole. Topic changes go to ``changes`` and, if given,
    changes of the broker count to ``brokers``. The last snapshot stays open until a later one
    comes. What is stored survives a restart.
    """
    late = F.expr(f"interval {delay}")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _write(batch, stored, number)
        table = spark.read.parquet(stored).filter(F.col("batch") <= number)
        # Two points in time; a batch that is run again finds the same ones.
        before, now = (
            f.agg(F.max("snapshot_at") - late).first()[0] for f in (table.filter(F.col("batch") < number), table)
        )
        closed = table.drop("batch").distinct()
        closed = closed.filter(F.col("snapshot_at") < F.lit(now)) if now is not None else closed.limit(0)
        if before is not None:
            # The last snapshot compared earlier is what the first new one follows.
            last = closed.filter(F.col("snapshot_at") < F.lit(before)).agg(F.max("snapshot_at").alias("_last"))
            closed = closed.crossJoin(F.broadcast(last)).filter("_last is null or snapshot_at >= _last").drop("_last")
        _write(config_history.config_delta_topics(closed), changes, number)
        if brokers:
            _write(config_history.config_delta_brokers(closed), brokers, number)

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because they came after the watermark."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )
