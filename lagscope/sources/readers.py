"""Reading inputs: tables, JSON messages, incident and runbook files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A stored table; formats are those Spark has built in (parquet, orc, json, csv)."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """New files of a stored table as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(path)


def offset_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.OFFSET_SNAPSHOT, fmt)


def partition_metadata(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.PARTITION_METADATA, fmt)


def runbooks(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as (runbook_id, content, filepath); the id is the file name."""
    return (
        spark.read.text(path, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("runbook_id"),
            F.col("value").alias("content"),
            F.col("_metadata.file_path").alias("filepath"),
        )
    )


def incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident files; each holds one JSON object or an array of them. The cluster state is
    read as the JSON text it is."""
    return spark.read.schema(schemas.INCIDENT).option("multiLine", True).json(path)


def parse_json(
    messages: DataFrame, schema: T.StructType, column: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Split messages into parsed ones (``data``) and a dead letter with the reason.

    A message is bad when it is missing, is not JSON, or does not fit the schema.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    # An array of one, unpacked: filters on what is parsed stay above it, so each text is parsed once.
    parsed = messages.select(
        "*",
        F.explode(
            F.array(
                F.from_json(
                    column, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
                )
            )
        ).alias("_parsed"),
    )
    reason = (
        F.when(F.col(column).isNull(), "missing value")
        .when(F.col("_parsed").isNull() | F.col("_parsed._corrupt_record").isNotNull(), "malformed JSON")
    )
    marked = parsed.withColumn("_reason", reason)
    data = F.struct(*[F.col(f"_parsed.{f.name}").alias(f.name) for f in schema.fields])
    good = marked.filter("_reason is null").select(*messages.columns, data.alias("data"))
    bad = marked.filter("_reason is not null").select(*messages.columns, F.col("_reason").alias("error"))
    return good, bad


def business_events(messages: DataFrame, topic: str) -> DataFrame:
    """Typed events of one business topic."""
    good, _ = parse_json(messages.filter(F.col("topic") == topic), schemas.BUSINESS_EVENTS[topic])
    return good.select("partition", "offset", "key", "data.*")


def poison_reason(value: Column, max_bytes: int = 1_000) -> Column:
    """Why a message may stop its consumer; null for a harmless one."""
    return (
        F.when(value.isNull(), "missing value")
        .when(F.try_parse_json(value).isNull(), "malformed JSON")
        .when(F.octet_length(value) > max_bytes, "oversized")
    )


def poison_messages(messages: DataFrame, stuck: DataFrame, max_bytes: int = 1_000) -> DataFrame:
    """Suspicious messages at offsets where a consumer stands still.

    ``stuck`` has (group_id, topic, partition, committed_offset). Messages are filtered before
    the join, so only suspicious ones are shuffled.
    """
    suspects = messages.withColumn("reason", poison_reason(F.col("value"), max_bytes)).filter("reason is not null")
    at = stuck.select("group_id", "topic", "partition", F.col("committed_offset").alias("offset")).distinct()
    return suspects.join(at, ["topic", "partition", "offset"]).select(
        "group_id", "topic", "partition", "offset", "key", "reason"
    )
