"""Input tables of the operators, derived by Spark from the given tables.

Row counts follow the given tables: more users give more topics, more customers more
partitions and topics, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import tasks_for

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC
HOUR_US = 3_600_000_000
USERS_PER_TOPIC = 64
SNAPSHOTS_PER_TASK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_time(h) -> F.Column:
    """Time of an hour index."""
    return F.timestamp_micros(F.lit(EPOCH_US) + h.cast("bigint") * HOUR_US)


def _hour_of(ts: str) -> F.Column:
    """Hour index, also of times before hour 0."""
    us = F.expr(f"unix_micros(cast(`{ts}` as timestamp)) - {EPOCH_US}")
    return F.floor((us - F.pmod(us, F.lit(HOUR_US))) / HOUR_US).cast("bigint")


def topic_of_event(users_per_topic: int | None = USERS_PER_TOPIC) -> F.Column:
    """Topic of an event: its type, split further by user so that topics grow with users."""
    if users_per_topic is None:
        return F.col("event_type")
    return F.concat_ws("-", "event_type", F.expr(f"user_id div {users_per_topic}"))


def snapshot_tasks(events: DataFrame, users_per_topic: int | None = USERS_PER_TOPIC) -> int | None:
    """Tasks for the rows of ``lag_snapshots``, where they are too many for the session's setting."""
    series = F.struct(topic_of_event(users_per_topic), F.col("user_id") % 8)
    h = _hour_of("ts")
    n, hours = events.agg(F.approx_count_distinct(series), F.max(h) - F.min(h) + 1).first()
    return tasks_for(events.sparkSession, 4 * n * (hours or 0), SNAPSHOTS_PER_TASK)


def lag_snapshots(
    events: DataFrame, users_per_topic: int | None = USERS_PER_TOPIC, tasks: int | None = None
) -> DataFrame:
    """Hourly offset snapshots of four consumer groups with known behaviour, from the first hour
    with an event to the last.

    g0 keeps up; g1 is three hours late; g2 stops for the last 12 of every 48 hours; g3 is an
    hour late and has partition 0 stuck from hour 240 on. Every (topic, partition) is cheap to
    lay out: hourly sums first, then the gaps between them are filled from the next row.

    ``tasks`` (see ``snapshot_tasks``) are as many as the session's shuffle partitions if left out.
    """
    hourly = (
        events.select(
            topic_of_event(users_per_topic).alias("topic"),
            (F.col("user_id") % 8).cast("int").alias("partition"),
            _hour_of("ts").alias("h"),
            (1 + F.floor(F.col("value") * 200)).cast("bigint").alias("m"),
        )
        .filter("h is not null")
        .groupBy("topic", "partition", "h")
        .agg(F.sum("m").alias("m"))
    )
    # One row, known before the others are laid out.
    span = events.select(_hour_of("ts").alias("h")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    hourly = hourly.crossJoin(F.broadcast(span))
    # Few small rows become many below, so adaptive execution must not merge these partitions. All
    # partitions of a topic (eight at most) go to one task, so that totals by topic combine there.
    parts = tasks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("topic", "partition")
    sparse = hourly.repartition(parts, "topic").select(
        "*",
        F.sum("m").over(w.orderBy("h")).alias("total"),
        F.lead("h", 1).over(w.orderBy("h")).alias("next_h"),
        (F.row_number().over(w.orderBy("h")) == 1).alias("first_row"),
    )
    filled = sparse.select(
        "topic",
        "partition",
        "h",
        "m",
        "total",
        "lo",
        F.explode(
            F.sequence(
                F.when(F.col("first_row"), F.col("lo")).otherwise(F.col("h")),
                F.coalesce("next_h", F.col("hi") + 1) - 1,
            )
        ).alias("k"),
    ).select(
        "topic",
        "partition",
        "k",
        "lo",
        F.when(F.col("k") >= F.col("h"), F.col("total"))
        .otherwise(F.col("total") - F.col("m"))
        .alias("log_end"),
    )
    order = w.orderBy("k")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    k, lo, end = F.col("k"), F.col("lo"), F.col("log_end")
    hour = k - lo
    stuck = (F.col("partition") == 0) & (hour >= 240)
    ends = filled.select(
        "topic",
        "partition",
        "k",
        "lo",
        "log_end",
        F.coalesce(F.lag("log_end", 3).over(order), F.first("log_end").over(order)).alias("c1"),
        F.max(F.when(hour % 48 < 36, end)).over(so_far).alias("c2"),
        F.when(stuck, F.max(F.when(hour <= 240, end)).over(so_far))
        .otherwise(F.coalesce(F.lag("log_end", 1).over(order), F.lit(0)))
        .alias("c3"),
    )
    stop = F.when(hour % 48 >= 36, k - hour % 48 + 35).otherwise(k)

    def group(name: str, committed: F.Column, commit_hour: F.Column) -> F.Column:
        return F.struct(
            F.lit(name).alias("group_id"),
            committed.cast("bigint").alias("committed"),
            commit_hour.cast("bigint").alias("e"),
        )

    return ends.select(
        "topic",
        "partition",
        "k",
        "log_end",
        F.explode(
            F.array(
                group("g0", end, k),
                group("g1", F.col("c1"), F.greatest(k - 3, lo)),
                group("g2", F.col("c2"), stop),
                group("g3", F.col("c3"), F.when(stuck, lo + 240).otherwise(k - 1)),
            )
        ).alias("g"),
    ).select(
        "g.group_id",
        "topic",
        "partition",
        F.col("g.committed").alias("committed_offset"),
        F.col("log_end").alias("log_end_offset"),
        hour_time(F.col("g.e")).alias("last_commit_at"),
        hour_time(k).alias("snapshotted_at"),
    )


def partition_metadata(customer: DataFrame) -> DataFrame:
    """One cluster scan: a partition per customer, with its leader and replicas."""
    leader = (
        F.when(F.col("c_acctbal") < -900, -1)
        .when(F.col("c_custkey") % 10 < 6, 0)
        .otherwise(F.col("c_nationkey") % 5)
        .cast("int")
    )
    return _with_replicas(
        customer.select(
            hour_time(F.lit(0)).alias("scan_at"),
            _segment_topic().alias("topic"),
            F.col("c_custkey").cast("int").alias("partition"),
            leader.alias("leader"),
            leader.alias("home"),
            (F.col("c_acctbal") < 0).alias("short"),
        )
    )


def partition_scans(customer: DataFrame, scans: int = 30) -> DataFrame:
    """A daily scan of the same cluster. Faults come and go: partitions are offline, or miss a
    replica, only on some days, by topic; on every fourth day leaders have moved."""
    s = F.col("s")
    phase = s + F.length("c_mktsegment")
    home = (
        F.when(F.col("c_custkey") % 10 < 6, 0).otherwise(F.col("c_nationkey") % 5).cast("int")
    )
    moved = F.when(s % 4 == 3, (home + F.col("c_custkey") % 3) % 5).otherwise(home).cast("int")
    return _with_replicas(
        customer.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(scans - 1)))).select(
            hour_time(s * 24).alias("scan_at"),
            _segment_topic().alias("topic"),
            F.col("c_custkey").cast("int").alias("partition"),
            F.when((F.col("c_acctbal") < -900) & (phase % 7 >= 3), -1)
            .otherwise(moved)
            .cast("int")
            .alias("leader"),
            home.alias("home"),
            ((F.col("c_acctbal") < 0) & (phase % 6 >= 2)).alias("short"),
        )
    )


def _segment_topic() -> F.Column:
    seg = F.col("c_mktsegment")
    return F.when(seg == "MACHINERY", F.concat(F.lit("__"), seg)).otherwise(seg)


def _with_replicas(rows: DataFrame) -> DataFrame:
    b = F.greatest(F.col("home"), F.lit(0))
    replicas = F.array(b, (b + 1) % 5, (b + 2) % 5)
    return rows.select(
        "scan_at",
        "topic",
        "partition",
        "leader",
        replicas.alias("replicas"),
        F.when(F.col("short"), F.slice(replicas, 1, 2)).otherwise(replicas).alias("isrs"),
    )


def brokers(supplier: DataFrame, scans: int = 30) -> DataFrame:
    """A broker per supplier; each is away on every fourth scan."""
    s = F.col("s")
    return (
        supplier.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(scans - 1))))
        .filter((F.col("s_suppkey") + s) % 4 != 0)
        .select(
            hour_time(s * 24).alias("scan_at"),
            F.col("s_suppkey").cast("int").alias("broker_id"),
            F.col("s_name").alias("host"),
            F.lit(9092).alias("port"),
        )
    )


def config_snapshots(orders: DataFrame) -> DataFrame:
    """A configuration snapshot per month; a topic is there in the months in which its
    customers order."""
    at = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    topic_no = F.expr("o_custkey div 50")
    rows = orders.select(at.alias("snapshot_at"), topic_no.alias("t")).groupBy("snapshot_at", "t").agg(
        F.count(F.lit(1)).alias("n")
    )
    return rows.select(
        "snapshot_at",
        (3 + F.month("snapshot_at") % 2).cast("bigint").alias("broker_count"),
        F.concat(F.lit("topic-"), F.col("t").cast("string")).alias("topic"),
        F.col("n").alias("partition_count"),
        (1 + F.col("n") % 3).cast("int").alias("replication_factor"),
    )


def analyses(orders: DataFrame) -> DataFrame:
    """Stored analyses, one per order."""
    p = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.col("o_orderkey").cast("string").alias("analysis_id"),
        F.when(F.col("o_orderstatus") == "F", "THRESHOLD_BREACH")
        .when(F.col("o_orderstatus") == "P", "ANOMALY_DETECTED")
        .otherwise("SCHEDULED_POLL")
        .alias("triggered_by"),
        F.col("o_orderdate").cast("timestamp").alias("analyzed_at"),
        F.when(p == "1", "CRITICAL")
        .when(p == "2", "HIGH")
        .when(p == "3", "MEDIUM")
        .otherwise("LOW")
        .alias("severity"),
        F.least(F.floor("o_totalprice") / 500000, F.lit(1.0)).alias("overall_confidence"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("llm_root_cause_summary"),
    )


def recommendations(lineitem: DataFrame) -> DataFrame:
    """Stored recommendations, one per line item."""
    from ..config import GROUNDINGS, PRIORITIES, RECOMMENDATION_TYPES, RISK_LEVELS

    n = F.col("l_linenumber")

    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))

    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("analysis_id"),
        n.alias("ordinal"),
        F.concat_ws("/", F.col("l_orderkey"), n, "l_partkey", "l_suppkey").alias("recommendation_id"),
        pick(RECOMMENDATION_TYPES, F.col("l_partkey")).alias("recommendation_type"),
        pick(PRIORITIES, n).alias("priority"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("rationale"),
        pick(RISK_LEVELS, F.col("l_suppkey")).alias("risk_level"),
        pick(GROUNDINGS, n + 1).alias("grounding"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 4).cast("string")).alias("consumer_group"),
        F.concat(F.lit("topic-"), F.col("l_partkey").cast("string")).alias("topic"),
        (n * 5).cast("int").alias("estimated_resolution_minutes"),
        (F.col("l_returnflag") == "R").alias("applied"),
    )


def audit_log(events: DataFrame) -> DataFrame:
    """Stored audit rows, one per event."""
    return events.select(
        F.col("event_id").alias("id"),
        F.upper("event_type").alias("event_type"),
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("consumer_group"),
        topic_of_event().alias("topic"),
        F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("logged_at"),
    )


def raw_messages(events: DataFrame) -> DataFrame:
    """Messages as they come off a log: JSON text of five kinds, some broken, some empty.

    Event types stand for the five business topics. Every 97th value is cut short, every 211th
    is missing, every 307th is very long.
    """
    e = F.col("event_id")
    topic = (
        F.when(F.col("event_type") == "purchase", "orders")
        .when(F.col("event_type") == "error", "payments")
        .when(F.col("event_type") == "signup", "inventory")
        .when(F.col("event_type") == "view", "user-events")
        .otherwise("notifications")
    )
    head = F.format_string(
        '{"event_id": "%d", "timestamp": "%s", "source": "%s"',
        e,
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"),
        topic,
    )
    cents = F.round(F.col("value") * 100).cast("bigint")
    amount = F.concat(F.expr("cast(cents div 100 as string)"), F.lit("."), F.lpad(F.expr("cast(cents % 100 as string)"), 2, "0"))
    user = F.col("user_id").cast("string")
    body = (
        F.when(
            topic == "orders",
            F.concat(
                F.lit(', "order_id": "ORD-'), e.cast("string"), F.lit('", "customer_id": "CUST-'), user,
                F.lit('", "status": "PLACED", "total_amount": '), amount,
                F.lit(', "items": '), (1 + e % 8).cast("string"), F.lit("}"),
            ),
        )
        .when(
            topic == "payments",
            F.concat(
                F.lit(', "payment_id": "PAY-'), e.cast("string"),
                F.lit('", "currency": "USD", "method": "card", "status": "FAILED", "amount": '), amount, F.lit("}"),
            ),
        )
        .when(
            topic == "inventory",
            F.concat(
                F.lit(', "product_id": "PROD-'), user, F.lit('", "warehouse": "EU-CENTRAL", "quantity_delta": '),
                (e % 61 - 10).cast("string"), F.lit("}"),
            ),
        )
        .when(
            topic == "user-events",
            F.concat(
                F.lit(', "user_id": "USR-'), user, F.lit('", "action": "login", "session_id": "S-'),
                e.cast("string"), F.lit('"}'),
            ),
        )
        .otherwise(
            F.concat(
                F.lit(', "notification_id": "N-'), e.cast("string"),
                F.lit('", "type": "SHIPPING_UPDATE", "channel": "push"}'),
            )
        )
    )
    full = F.concat(head, body)
    padded = F.concat(head, F.lit(', "pad": "'), F.repeat(F.lit("x"), 2000), F.lit('"'), body)
    value = (
        F.when(e % 211 == 5, F.lit(None).cast("string"))
        .when(e % 97 == 0, F.substring(full, 1, 60))
        .when(e % 307 == 7, padded)
        .otherwise(full)
    )
    return events.withColumn("cents", cents).select(
        topic.alias("topic"),
        (F.col("user_id") % 8).cast("int").alias("partition"),
        e.alias("offset"),
        F.concat(F.lit("USR-"), user).alias("key"),
        value.alias("value"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


LABEL_CLASSES = (
    "GROWING_LAG",
    "STALLED_CONSUMER",
    "SINGLE_PARTITION_STALL",
    "THUNDERING_HERD",
    "CATCHUP_IN_PROGRESS",
)
CHUNK_TYPES = ("cluster_state", "symptoms", "resolution")


def _nth(values, index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def incident_vectors(embeddings: DataFrame) -> DataFrame:
    """Incident chunks with vectors: three chunks make an incident."""
    v = F.col("vec_id")
    return embeddings.select(
        v.alias("id"),
        F.concat(F.lit("INC-"), F.expr("vec_id div 3").cast("string")).alias("incident_id"),
        _nth(CHUNK_TYPES, v).alias("chunk_type"),
        _nth(LABEL_CLASSES, F.col("label")).alias("lag_classification"),
        F.concat(F.lit("g"), (v % 4).cast("string")).alias("consumer_group"),
        F.concat(F.lit("topic-"), F.col("label").cast("string")).alias("topic"),
        F.lit("CONSUMER_RESTART").alias("resolution_type"),
        (5 + v % 50).cast("int").alias("time_to_resolution_minutes"),
        F.concat(F.lit("summary "), v.cast("string")).alias("summary"),
        "embedding",
    )


def runbook_vectors(embeddings: DataFrame) -> DataFrame:
    """Runbook sections with vectors, each tagged with one or two lag classes."""
    v, label = F.col("vec_id"), F.col("label")
    return embeddings.select(
        v.alias("id"),
        F.concat(F.lit("RB-"), F.expr("vec_id div 4").cast("string")).alias("runbook_id"),
        F.concat(F.lit("Runbook "), F.expr("vec_id div 4").cast("string")).alias("title"),
        F.concat(F.lit("section "), (v % 4).cast("string")).alias("section"),
        F.concat(F.lit("text "), v.cast("string")).alias("content"),
        F.array_distinct(
            F.array(_nth(LABEL_CLASSES, label), _nth(LABEL_CLASSES, label + v % 2))
        ).alias("lag_classifications"),
        "embedding",
    )


def _means(vectors: DataFrame, *keys: Column) -> DataFrame:
    """Mean vector of each group: of every position over the vectors that have it."""
    names = [f"k{i}" for i in range(len(keys))]
    entries = vectors.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.posexplode("embedding").alias("pos", "x"))
    means = entries.groupBy(*names, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    whole = means.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("entries"))
    return whole.select(*names, F.col("entries.mean").alias("embedding"))


def query_vectors(embeddings: DataFrame) -> DataFrame:
    """One query per (label, chunk type): the mean of its vectors."""
    return _means(embeddings, F.col("label"), F.col("vec_id") % 3).select(
        F.format_string("Q-%d-%d", F.col("k0").cast("bigint"), F.col("k1")).alias("query_id"),
        _nth(LABEL_CLASSES, F.col("k0")).alias("lag_classification"),
        "embedding",
    )


def incidents(conversations: DataFrame) -> DataFrame:
    """Incidents, one per conversation turn."""
    c, t = F.col("conv_id"), F.col("turn")
    return conversations.select(
        F.concat_ws("-", F.lit("INC"), c, t).alias("incident_id"),
        F.concat(F.lit("g"), (c % 4).cast("string")).alias("consumer_group"),
        F.concat(F.lit("topic-"), (c % 10).cast("string")).alias("topic"),
        _nth(LABEL_CLASSES, c + t).alias("lag_classification"),
        F.when(t % 2 == 0, "HIGH").otherwise("CRITICAL").alias("severity"),
        F.when(t % 3 == 0, "CONSUMER_RESTART").otherwise("CONSUMER_SCALE_OUT").alias("resolution_type"),
        F.col("text").alias("resolution_notes"),
        F.when((c + t) % 5 == 0, " ").otherwise(F.col("text")).alias("symptoms_description"),
        F.concat(F.lit("summary of "), c.cast("string")).alias("summary"),
        (3 + (c * 7 + t) % 120).cast("int").alias("time_to_resolution_minutes"),
        F.concat(F.lit('{"turn": '), t.cast("string"), F.lit("}")).alias("cluster_state_at_onset"),
    )


def runbook_docs(documents: DataFrame) -> DataFrame:
    """Runbook texts, one per document."""
    return documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("runbook_id"),
        F.col("text").alias("content"),
    )


def class_query_vectors(embeddings: DataFrame) -> DataFrame:
    """One query per lag class: the mean of the vectors with its labels."""
    return _means(embeddings, _nth(LABEL_CLASSES, F.col("label"))).select(
        F.col("k0").alias("query_id"), F.col("k0").alias("lag_classification"), "embedding"
    )


def consumer_groups(supplier: DataFrame) -> DataFrame:
    """Consumer groups with a state, one per supplier."""
    return supplier.select(
        F.col("s_name").alias("group_id"),
        _nth(("Stable", "Empty", "Dead", "PreparingRebalance"), F.col("s_nationkey")).alias("state"),
    )


def model_outputs(lineitem: DataFrame) -> DataFrame:
    """JSON as a model might return it, one per line item: complete, with fields missing, with
    an unknown value, or cut off."""
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(p % 11 == 0, "REBOOT_EVERYTHING").otherwise("CONSUMER_RESTART")
    priority = F.when(p % 13 == 0, "SOON").otherwise("IMMEDIATE")
    first = F.concat(
        F.lit('{"recommendation_type": "'), kind, F.lit('", "priority": "'), priority,
        F.lit('", "rationale": "part '), p.cast("string"),
        F.lit('", "risk_level": "LOW", "grounding": "RUNBOOK", "estimated_resolution_minutes": '),
        n.cast("string"), F.lit(', "topic": "t'), (p % 7).cast("string"), F.lit('"}'),
    )
    second = F.lit('{"rationale": "defaults only"}')
    listed = F.when(n % 2 == 0, F.concat(first, F.lit(", "), second)).otherwise(first)
    output = F.concat(
        F.lit('{"root_cause_summary": "s", "recommendations": ['), listed, F.lit('], "confidence": 0.5}')
    )
    return lineitem.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("analysis_id"),
        F.when(p % 17 == 0, F.substring(output, 1, 50)).otherwise(output).alias("output"),
    )


def cycle_outputs(cycles: DataFrame) -> DataFrame:
    """Model output of each cycle, by its hour: a third complete, a third cut off, a third missing."""
    k = F.expr(f"unix_micros(snapshotted_at) div {HOUR_US}")
    whole = F.concat(
        F.lit('{"root_cause_summary": "cause '), k.cast("string"),
        F.lit('", "recommendations": [{"rationale": "model"}, {"priority": "SOON"}], "confidence": 0.75}'),
    )
    return cycles.filter(k % 3 < 2).select(
        "snapshotted_at", F.when(k % 3 == 0, whole).otherwise(F.substring(whole, 1, 30)).alias("output")
    )
