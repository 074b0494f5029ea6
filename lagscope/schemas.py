"""Schemas of the inputs, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

OFFSET_SNAPSHOT = T.StructType(
    [
        T.StructField("group_id", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("committed_offset", T.LongType()),
        T.StructField("log_end_offset", T.LongType()),
        T.StructField("last_commit_at", T.TimestampType()),
        T.StructField("snapshotted_at", T.TimestampType()),
    ]
)

CONSUMER_GROUP = T.StructType(
    [T.StructField("group_id", T.StringType()), T.StructField("state", T.StringType())]
)

PARTITION_METADATA = T.StructType(
    [
        T.StructField("scan_at", T.TimestampType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("leader", T.IntegerType()),
        T.StructField("replicas", T.ArrayType(T.IntegerType())),
        T.StructField("isrs", T.ArrayType(T.IntegerType())),
    ]
)

BROKER = T.StructType(
    [
        T.StructField("scan_at", T.TimestampType()),
        T.StructField("broker_id", T.IntegerType()),
        T.StructField("host", T.StringType()),
        T.StructField("port", T.IntegerType()),
    ]
)

CONFIG_SNAPSHOT = T.StructType(
    [
        T.StructField("snapshot_at", T.TimestampType()),
        T.StructField("broker_count", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition_count", T.LongType()),
        T.StructField("replication_factor", T.IntegerType()),
    ]
)

INCIDENT = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("consumer_group", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("lag_classification", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("resolution_type", T.StringType()),
        T.StructField("resolution_notes", T.StringType()),
        T.StructField("symptoms_description", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("time_to_resolution_minutes", T.IntegerType()),
        T.StructField("cluster_state_at_onset", T.StringType()),
    ]
)

RECOMMENDATION = T.StructType(
    [
        T.StructField("recommendation_type", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("grounding", T.StringType()),
        T.StructField("consumer_group", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("estimated_resolution_minutes", T.IntegerType()),
        T.StructField("cli_commands", T.ArrayType(T.StringType())),
    ]
)

MODEL_OUTPUT = T.StructType(
    [
        T.StructField("root_cause_summary", T.StringType()),
        T.StructField("recommendations", T.ArrayType(RECOMMENDATION)),
        T.StructField("confidence", T.DoubleType()),
    ]
)

RAW_MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

_EVENT_BASE = [
    T.StructField("event_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
]


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


BUSINESS_EVENTS = {
    "orders": T.StructType(
        _EVENT_BASE
        + _strings("order_id", "customer_id", "status")
        + [T.StructField("total_amount", T.DoubleType()), T.StructField("items", T.IntegerType())]
    ),
    "payments": T.StructType(
        _EVENT_BASE
        + _strings("payment_id", "currency", "method", "status")
        + [T.StructField("amount", T.DoubleType())]
    ),
    "inventory": T.StructType(
        _EVENT_BASE
        + _strings("product_id", "warehouse")
        + [T.StructField("quantity_delta", T.IntegerType())]
    ),
    "user-events": T.StructType(_EVENT_BASE + _strings("user_id", "action", "session_id")),
    "notifications": T.StructType(_EVENT_BASE + _strings("notification_id", "type", "channel")),
}
