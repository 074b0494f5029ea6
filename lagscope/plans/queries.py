"""Every registered query: operators over tables that Spark derives from the given ones.

The derived snapshots are hourly, so periods are in hours here (``HOURLY``); everything else is
as in the defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.columns import snapshot_id, stable_id
from ..operators import (
    config_history,
    dedup,
    health,
    ivf,
    knowledge,
    lag,
    metrics,
    recommend,
    reports,
    retrieval,
)
from ..schemas import BUSINESS_EVENTS, _EVENT_BASE
from ..sources import derived as D
from ..session import store, working_dir
from ..sources import readers, sinks
from ..streaming import jobs
from .cycle import hits_of_cycle, lag_cycle, scan_health

Query = Callable[[SparkSession, str], DataFrame]

HOUR = 3600
HOURLY = replace(
    DEFAULTS,
    stall_seconds=6 * HOUR,
    history_seconds=5 * HOUR + HOUR // 2,
    escalation_lag=50_000,
    escalation_seconds=4 * HOUR,
    dedup_ttl_seconds=6 * HOUR,
    bucket_seconds=10 * 86_400,
)
DAILY = replace(HOURLY, bucket_seconds=366 * 86_400)
THRESHOLD = 0.1
KEYWORDS = ("THE", "UND", "QUE", "OF_THE", "DE_LA", "Error")
KEYWORD_DEFAULT = ("GROWING_LAG",)

REGISTRY: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Times without zone, and doubles rounded to six digits, for comparison."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable) -> Callable:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return tidy(fn(Inputs(spark, sf_dir)))

    REGISTRY[fn.__name__] = run
    return run


class Inputs:
    """Derived inputs of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.dir, name)

    def snapshots(self) -> DataFrame:
        return D.lag_snapshots(self.table("events"), tasks=self.hourly.shuffle_tasks)

    @cached_property
    def hourly(self) -> Thresholds:
        """``HOURLY``, with tasks for as many snapshots as there are."""
        return replace(HOURLY, shuffle_tasks=D.snapshot_tasks(self.table("events")))

    def lags(self) -> DataFrame:
        return lag.lag_by_partition(self.snapshots(), cfg=HOURLY)

    def topics(self) -> DataFrame:
        return lag.topic_lag(self.lags())

    def velocity(self) -> DataFrame:
        return lag.with_velocity(self.topics(), HOURLY)

    def scored(self) -> DataFrame:
        return lag.analyze_topics(self.snapshots(), HOURLY)

    def groups(self) -> DataFrame:
        return lag.group_rollup(self.scored())

    def meta(self) -> DataFrame:
        return D.partition_scans(self.table("customer"))

    def brokers(self) -> DataFrame:
        return D.brokers(self.table("supplier"))

    def cycles(self) -> DataFrame:
        return health.attach_health(lag.cycles(self.groups(), HOURLY), scan_health(self.meta()), HOUR)

    def configs(self) -> DataFrame:
        return D.config_snapshots(self.table("orders"))

    def analyses(self) -> DataFrame:
        return D.analyses(self.table("orders"))

    def recommendations(self) -> DataFrame:
        return D.recommendations(self.table("lineitem"))

    def rates(self) -> DataFrame:
        # Read by the totals, the shares and the hotspots.
        return store(health.partition_rates(self.snapshots(), self.hourly), "rates")

    def hotspots(self, rates: DataFrame | None = None) -> DataFrame:
        return health.partition_hotspots(self.rates() if rates is None else rates)

    def messages(self) -> DataFrame:
        return D.raw_messages(self.table("events"))

    def incident_vectors(self) -> DataFrame:
        return D.incident_vectors(self.table("embeddings"))

    def runbook_vectors(self) -> DataFrame:
        return D.runbook_vectors(self.table("embeddings"))

    def queries(self) -> DataFrame:
        return D.query_vectors(self.table("embeddings"))

    def class_queries(self) -> DataFrame:
        return D.class_query_vectors(self.table("embeddings"))

    def cycle(self):
        return lag_cycle(self.snapshots(), self.meta(), self.hourly, HOUR)

    def cycle_hits(self, worst: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = self.class_queries()
        incidents = retrieval.similar_incidents(q, self.incident_vectors(), threshold=THRESHOLD)
        runbooks = retrieval.runbook_search(q, self.runbook_vectors(), threshold=THRESHOLD)
        return hits_of_cycle(worst, incidents), hits_of_cycle(worst, runbooks)

    def events(self) -> DataFrame:
        c = self.cycle()
        incidents, runbooks = self.cycle_hits(c.worst)
        return recommend.analysis_events(c.cycles, c.topics, c.recommendations, incidents, runbooks)


# ---------------------------------------------------------------- sources and sinks


@query
def offset_snapshots(i):
    return i.snapshots()


@query
def partition_metadata(i):
    return i.meta().select(
        "scan_at", "topic", "partition", "leader",
        F.array_join(F.transform("replicas", lambda x: x.cast("string")), ",").alias("replicas"),
        F.array_join(F.transform("isrs", lambda x: x.cast("string")), ",").alias("isrs"),
    )


@query
def recent_lag_history(i):
    return lag.recent_lag_history(i.lags(), minutes=24 * 60)


@query
def analysis_insert_ignore(i):
    a = i.analyses()
    stored = a.filter("triggered_by = 'THRESHOLD_BREACH'")
    again = a.withColumn("analyzed_at", F.expr("analyzed_at + interval 1 day"))
    return sinks.insert_ignore(
        a.unionByName(again), stored, "analysis_id", ["analyzed_at"], size=2 * i.table("orders").count()
    )


@query
def audit_rows(i):
    counts = i.recommendations().groupBy("analysis_id").agg(F.count(F.lit(1)).alias("recommendation_count"))
    done = (
        i.analyses()
        .join(counts, "analysis_id", "left")
        .select(
            "analysis_id", "severity",
            F.coalesce("recommendation_count", F.lit(0)).alias("recommendation_count"),
            F.col("overall_confidence").alias("confidence"), "analyzed_at",
        )
    )
    return sinks.audit_rows(
        done, "LAG_ANALYSIS_COMPLETED",
        ["analysis_id", "severity", "recommendation_count", "confidence"], "analyzed_at",
    )


@query
def publish_routes(i):
    recs = i.recommendations().groupBy("analysis_id").agg(
        F.sort_array(F.collect_list("recommendation_id")).alias("recommendations")
    )
    events = (
        i.analyses()
        .join(recs, "analysis_id", "left")
        .select(
            "analysis_id", "severity",
            F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"),
        )
    )
    return sinks.publish_routes(events)


@query
def json_dead_letter(i):
    from pyspark.sql import types as T

    _, bad = readers.parse_json(i.messages(), T.StructType(_EVENT_BASE))
    return bad.select("topic", "partition", "offset", "key", "value", "error")


@query
def business_events(i):
    from pyspark.sql import types as T

    good, _ = readers.parse_json(i.messages(), T.StructType(_EVENT_BASE))
    return good.select(
        "topic", "partition", "offset", "data.event_id", F.col("data.timestamp").alias("event_time"), "data.source"
    )


def _business(topic: str) -> None:
    def fn(i):
        return readers.business_events(i.messages(), topic).withColumnRenamed("timestamp", "event_time")

    fn.__name__ = "business_events_" + topic.replace("-", "_")
    query(fn)


for _topic in BUSINESS_EVENTS:
    _business(_topic)


@query
def vector_upsert(i):
    e = i.table("embeddings")
    stored = e.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 3).alias("version"))
    new = e.select((F.col("vec_id") * 2).alias("id"), (F.col("label") + 100).alias("label"), F.lit(1).cast("bigint").alias("version"))
    return sinks.vector_upsert(stored, new)


# ---------------------------------------------------------------- filters and predicates


@query
def active_groups(i):
    return lag.active_groups(D.consumer_groups(i.table("supplier")))


@query
def lag_by_partition(i):
    return i.lags()


@query
def topics_with_lag(i):
    return lag.topics_with_lag(i.lags())


@query
def high_severity_groups(i):
    return lag.high_severity_groups(i.groups(), HOURLY)


@query
def actionable_cycles(i):
    return lag.actionable_cycles(i.cycles())


@query
def severity_label(i):
    return lag.with_severity(i.scored(), HOURLY).groupBy("snapshotted_at", "group_id", "severity").agg(
        F.count(F.lit(1)).alias("topics")
    )


@query
def cycle_severity(i):
    return lag.cycle_severity(i.cycles(), HOURLY).select("snapshotted_at", "max_score", "severity")


@query
def stalled_partitions(i):
    return lag.stalled_partitions(i.lags())


# ---------------------------------------------------------------- lag


@query
def topic_total_lag(i):
    return i.topics()


@query
def lag_velocity(i):
    return i.velocity().select(*lag.SNAPSHOT, "total_lag", "lag_velocity_per_min")


@query
def lag_classification(i):
    return (
        lag.classify(i.velocity(), HOURLY)
        .groupBy("group_id", "topic", "lag_classification")
        .agg(F.count(F.lit(1)).alias("snapshots"), F.sum("total_lag").alias("lag_sum"))
    )


@query
def lag_severity(i):
    return lag.with_severity(i.scored(), HOURLY).select(
        *lag.SNAPSHOT, "total_lag", "lag_velocity_per_min", "lag_classification", "severity_score", "severity"
    )


@query
def problematic_partitions(i):
    return lag.problematic_partitions(i.lags())


@query
def topic_details(i):
    d = lag.topic_details(i.lags(), i.scored())
    return d.select(
        *lag.SNAPSHOT, "lag_classification",
        F.size("partitions").alias("partition_entries"),
        F.aggregate("partitions", F.lit(0).cast("bigint"), lambda a, p: a + p["lag"]).alias("partition_lag"),
        F.array_join(F.transform("problematic_partitions", lambda p: p.cast("string")), ",").alias("problematic"),
    )


@query
def group_severity(i):
    return i.groups()


@query
def worst_group_topic(i):
    return lag.worst_group_topic(i.scored(), HOURLY)


@query
def groups_monitored(i):
    return lag.groups_monitored(i.snapshots())


@query
def last_commit_at(i):
    # Only what is returned, so that both branches of the operator read the same rows.
    offsets = i.snapshots().select(*lag.SERIES, "snapshotted_at", "committed_offset")
    return lag.with_last_commit(offsets, i.hourly).select(*lag.SERIES, "snapshotted_at", "last_commit_at")


@query
def lag_acceleration(i):
    return lag.lag_acceleration(i.velocity(), HOURLY).select(
        *lag.SNAPSHOT, "lag_velocity_per_min", "previous_velocity", "acceleration", "trend"
    )


@query
def lag_trend(i):
    return lag.lag_trend(i.topics(), HOURLY, window_seconds=6 * HOUR).select(
        *lag.SNAPSHOT, "total_lag", "lag_slope_per_min", "trend_points", "previous_slope", "slope_change"
    )


@query
def simultaneous_lag(i):
    return lag.simultaneous_lag(i.velocity())


@query
def catch_up_minutes(i):
    return lag.catch_up(i.topics(), i.hourly)


@query
def lag_escalations(i):
    return metrics.lag_escalations(i.velocity(), i.hourly).select(
        *lag.SNAPSHOT, "total_lag", "lag_velocity_per_min", "active_since"
    )


@query
def partition_increase_plan(i):
    messages = i.table("events").select(
        D.topic_of_event().alias("topic"), (F.col("user_id") % 8).alias("partition"), F.col("user_id").alias("key")
    )
    partitions = messages.groupBy("topic").agg(
        F.countDistinct("partition").alias("partition_count"), F.lit(3).alias("replication_factor")
    )
    consumers = messages.groupBy("topic").agg((F.max("key") % 11).alias("consumers"))
    return lag.partition_increase_plan(partitions, messages, consumers)


@query
def reset_impact(i):
    lags = i.lags()
    targets = lags.groupBy("group_id").agg((F.max("snapshotted_at") - F.expr("interval 100 hours")).alias("target_at"))
    return lag.reset_impact(lags, targets).unionByName(lag.reset_impact(lags))


# ---------------------------------------------------------------- health


@query
def partition_health(i):
    return health.partition_health(i.meta())


@query
def broker_leader_counts(i):
    return health.broker_leader_counts(i.meta())


@query
def leader_imbalance(i):
    return health.leader_imbalance(i.meta())


@query
def health_summary(i):
    return health.health_summary(i.meta()).withColumn(
        "broker_partition_counts",
        F.array_join(
            F.transform(F.map_entries("broker_partition_counts"), lambda e: F.concat_ws(":", e["key"], e["value"])), ","
        ),
    )


@query
def cycle_health(i):
    return i.cycles()


@query
def partition_hotspots(i):
    return i.hotspots()


@query
def hotspot_cleared(i):
    rates = i.rates()
    return health.hotspot_cleared(rates, i.hotspots(rates))


@query
def hot_keys(i):
    records = i.table("events").select(
        D.topic_of_event().alias("topic"), (F.col("user_id") % 8).cast("int").alias("partition"),
        F.col("user_id").alias("key"),
    )
    return health.hot_keys(records, i.hotspots())


@query
def lagging_brokers(i):
    return health.lagging_brokers(i.meta())


@query
def leader_fair_share(i):
    return health.leader_fair_share(i.meta())


@query
def non_preferred_leaders(i):
    return health.non_preferred_leaders(i.meta())


# ---------------------------------------------------------------- configuration


@query
def config_snapshot(i):
    return config_history.config_snapshot(i.meta(), i.brokers())


@query
def config_delta_topics(i):
    return config_history.config_delta_topics(i.configs())


@query
def config_delta_brokers(i):
    return config_history.config_delta_brokers(i.configs())


@query
def config_delta_summary(i):
    return config_history.config_delta_summary(i.configs())


@query
def config_snapshot_ids(i):
    return i.configs().groupBy("snapshot_at").agg(F.count(F.lit(1)).alias("topics")).select(
        "snapshot_at", "topics",
        snapshot_id(F.date_format("snapshot_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("id"),
    )


# ---------------------------------------------------------------- knowledge


def _sections(i):
    return knowledge.section_chunks(D.runbook_docs(i.table("documents")), delimiter="\n")


@query
def section_chunks(i):
    return _sections(i)


@query
def keyword_tags(i):
    tagged = knowledge.keyword_tags(D.runbook_docs(i.table("documents")), KEYWORDS, KEYWORD_DEFAULT)
    return tagged.select("runbook_id", F.array_join("lag_classifications", ",").alias("tags"))


@query
def incident_chunks(i):
    return knowledge.incident_chunks(D.incidents(i.table("conversations")))


@query
def chunk_ids(i):
    return _sections(i).select("runbook_id", "section_no", "id")


@query
def incident_coverage(i):
    return knowledge.incident_coverage(D.incidents(i.table("conversations")))


# ---------------------------------------------------------------- retrieval


@query
def cosine_scores(i):
    v = i.incident_vectors().select("id", "incident_id", "embedding")
    first = v.groupBy("incident_id").agg(F.min_by("embedding", "id").alias("first_embedding"))
    return retrieval.cosine_scores(v.join(first, "incident_id"), "embedding", "first_embedding").select(
        "incident_id", "id", "score"
    )


@query
def vector_topk(i):
    return retrieval.vector_topk(i.queries(), i.incident_vectors(), 20, THRESHOLD).select(
        "query_id", "id", "score", "position"
    )


@query
def similar_incidents(i):
    return retrieval.similar_incidents(i.queries(), i.incident_vectors(), threshold=THRESHOLD)


@query
def runbook_search(i):
    return retrieval.runbook_search(i.queries(), i.runbook_vectors(), threshold=THRESHOLD)


@query
def retrieval_query_text(i):
    return retrieval.retrieval_query_text(lag.worst_group_topic(i.scored(), HOURLY))


@query
def config_similarity(i):
    past = i.table("embeddings").select(
        F.concat(F.lit("CFG-"), F.col("vec_id").cast("string")).alias("id"), "embedding"
    )
    return retrieval.vector_topk(i.class_queries(), past, 5, THRESHOLD).select("query_id", "id", "score", "position")


@query
def vector_topk_ivf(i):
    return ivf.vector_topk_ivf(i.queries(), i.incident_vectors(), 20, THRESHOLD).select("query_id", "id", "score", "position")


@query
def vector_topk_lsh(i):
    return retrieval.vector_topk_lsh(i.queries(), i.incident_vectors(), 20, THRESHOLD).select(
        "query_id", "id", "score", "position"
    )


# ---------------------------------------------------------------- recommendations


@query
def heuristic_topic_recs(i):
    return recommend.heuristic_topic_recs(i.scored()).drop("stage", "cli_commands")


@query
def heuristic_cluster_recs(i):
    scans = scan_health(i.meta()).withColumnRenamed("scan_at", "snapshotted_at")
    return recommend.heuristic_cluster_recs(scans).withColumn("cli_commands", F.array_join("cli_commands", ";"))


@query
def ranked_recs(i):
    return i.cycle().recommendations.drop("cli_commands")


@query
def validated_recs(i):
    valid, _ = recommend.validate_recs(D.model_outputs(i.table("lineitem")))
    return valid.withColumn("cli_commands", F.size("cli_commands"))


@query
def rejected_recs(i):
    _, rejected = recommend.validate_recs(D.model_outputs(i.table("lineitem")))
    return rejected.select("analysis_id", "item_no", "rejected_for")


@query
def analysis_context(i):
    c = i.cycle()
    incidents, runbooks = i.cycle_hits(c.worst)
    topics = c.topics.join(lag.problematic_lists(i.lags()), lag.SNAPSHOT, "left")
    return recommend.analysis_context(topics, c.cycles, incidents, runbooks)


@query
def analysis_event(i):
    e = i.events()
    return e.select(
        "analysis_id", "part", "analyzed_at", "severity",
        F.size("consumer_groups").alias("groups"),
        F.aggregate("consumer_groups", F.lit(0), lambda a, g: a + F.size(g["topics"])).alias("topics"),
        F.size("recommendations").alias("recommendations"),
        F.size("similar_incidents").alias("incidents"),
        F.size("runbook_references").alias("runbooks"),
        F.col("partition_health.offline").alias("offline"),
    )


@query
def event_from_model(i):
    c = i.cycle()
    outputs = D.cycle_outputs(c.cycles)
    valid, _ = recommend.validate_recs(outputs)
    results = recommend.model_results(outputs)
    recs = recommend.choose_recs(c.recommendations, valid, results)
    e = recommend.analysis_events(c.cycles, c.topics, recs, results=results)
    return e.select(
        "analysis_id", "analyzed_at", "llm_root_cause_summary", "overall_confidence",
        F.array_join(F.transform("recommendations", lambda r: F.concat_ws(":", r["ordinal"].cast("string"), r["recommendation_type"])), ",").alias("recommendations"),
    )


@query
def recommendation_rows(i):
    return recommend.recommendation_rows(i.events()).drop("cli_commands")


@query
def reference_ids(i):
    r = recommend.reference_ids(i.events())
    return r.select(
        "analysis_id", "part",
        F.array_join("similar_incidents", ",").alias("similar_incidents"),
        F.array_join("runbook_references", ",").alias("runbook_references"),
    )


# ---------------------------------------------------------------- reports


@query
def list_analyses(i):
    return reports.list_analyses(i.analyses(), severity="critical")


@query
def get_analysis(i):
    return reports.get_analysis(i.analyses(), "77")


@query
def consumer_group_lag(i):
    return reports.consumer_group_lag(i.lags(), "g1")


@query
def list_recommendations(i):
    return reports.list_recommendations(i.recommendations(), i.analyses(), applied=True)


@query
def list_cluster_configs(i):
    newest = config_history.newest_snapshots(i.configs(), 10)
    return reports.list_cluster_configs(config_history.config_table(newest), 10)


@query
def audit_log(i):
    return reports.audit_log(D.audit_log(i.table("events")), "purchase")


@query
def top_lag(i):
    return lag.top_lag(i.lags())


# ---------------------------------------------------------------- metrics and alerts


@query
def lag_sum_series(i):
    return metrics.lag_sum_series(i.lags())


@query
def lag_partition_series(i):
    return metrics.lag_partition_series(i.lags())


@query
def health_panel(i):
    return metrics.health_panel(i.meta(), i.brokers())


@query
def produce_rate(i):
    return metrics.produce_rate(i.snapshots(), 2 * HOUR, HOURLY)


@query
def analyses_total(i):
    return metrics.running_counter(i.analyses(), ["severity"], "analyzed_at")


@query
def recommendations_total(i):
    return metrics.counter(i.recommendations(), ["recommendation_type", "priority"])


@query
def unhealthy_partitions(i):
    return metrics.unhealthy_partitions(i.meta())


@query
def alert_states(i):
    series = metrics.lag_sum_series(i.lags())
    return metrics.alert_states(series, F.col("value") > 10_000, 5 * HOUR, ["group_id", "topic"], cfg=i.hourly)


@query
def alert_lag_high(i):
    return metrics.alert_lag_high(metrics.lag_sum_series(i.lags()), 5 * HOUR, i.hourly)


@query
def alert_lag_critical(i):
    return metrics.alert_lag_critical(metrics.lag_sum_series(i.lags()), 2 * HOUR, i.hourly)


@query
def alert_under_replicated(i):
    return metrics.alert_under_replicated(i.meta(), 24 * HOUR, DAILY)


@query
def alert_offline(i):
    return metrics.alert_offline(i.meta(), 24 * HOUR, DAILY)


# ---------------------------------------------------------------- state over time


@query
def ttl_dedup(i):
    return dedup.ttl_dedup(
        lag.worst_group_topic(i.scored(), HOURLY),
        ["group_id", "lag_classification", "topic"],
        "snapshotted_at",
        HOURLY.dedup_ttl_seconds,
        slice_seconds=86_400,
    ).select("group_id", "lag_classification", "topic", "snapshotted_at")


@query
def messages_per_minute(i):
    return metrics.messages_per_window(i.messages(), "timestamp", "1 minute")


@query
def messages_sliding(i):
    return metrics.messages_per_window(i.messages(), "timestamp", "10 minutes", "5 minutes")


@query
def poison_messages(i):
    m = i.messages()
    stuck = m.select(
        F.concat(F.lit("g"), (F.col("offset") % 4).cast("string")).alias("group_id"),
        "topic",
        "partition",
        F.col("offset").alias("committed_offset"),
    )
    return readers.poison_messages(m, stuck)


# ---------------------------------------------------------------- streams
#
# Each runs a stream to its end over a stored table and returns what it wrote. One row far in
# the future moves the watermark past all others; it is taken out again.

FLUSH = "2100-01-01 00:00:00"
#: Rows of a stored file: readers fill a task by bytes, and these rows take very few.
ROWS_PER_FILE = 250_000


def _streamed(i: Inputs, table: DataFrame, ts: str, flush: dict, transform) -> DataFrame:
    """Store a table, stream it through ``transform`` into a new table, and read that."""
    row = i.spark.range(1).select(
        *[
            (F.lit(FLUSH) if f.name == ts else F.lit(flush.get(f.name))).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )
    source, target, state = (working_dir(i.spark, f"stream-{n}") for n in ("input", "output", "state"))
    table.unionByName(row).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(source)
    out = transform(readers.stream_table(i.spark, source, table.schema))
    jobs.start_table(out, target, state).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.schema(out.schema).parquet(target)


@query
def stream_lag_totals(i):
    flush = {"group_id": "~", "topic": "~", "partition": 0, "committed_offset": 0, "log_end_offset": 0}
    out = _streamed(i, i.snapshots(), "snapshotted_at", flush, lambda s: jobs.lag_totals(s, "2 hours", HOURLY))
    return out.filter("group_id <> '~'")


@query
def stream_velocity(i):
    flush = {"group_id": "~", "topic": "~", "total_lag": 0, "total_lag_raw": 0, "partition_rows": 0,
             "lagging_partitions": 0, "stalled_count": 0, "max_lag": 0}
    topics = i.topics().select(*lag.SNAPSHOT, *jobs.TOPIC_COLUMNS)
    out = _streamed(i, topics, "snapshotted_at", flush, lambda s: jobs.velocity(s, "2 hours", HOURLY))
    return out.filter("group_id <> '~'").select(*lag.SNAPSHOT, "total_lag", "lag_velocity_per_min")


@query
def stream_alert_states(i):
    out = _streamed(
        i, metrics.lag_sum_series(i.lags()), "ts", {"group_id": "~", "topic": "~", "value": 0},
        lambda s: jobs.alert_states(s, F.col("value") > 10_000, 5 * HOUR, ["group_id", "topic"], delay="2 hours"),
    )
    return out.filter("group_id <> '~'")


@query
def stream_ttl_dedup(i):
    keys = ["group_id", "lag_classification", "topic"]
    hits = lag.worst_group_topic(i.scored(), HOURLY).select(*keys, "snapshotted_at")
    out = _streamed(
        i, hits, "snapshotted_at", {k: "~" for k in keys},
        lambda s: jobs.ttl_dedup(s, keys, "snapshotted_at", HOURLY.dedup_ttl_seconds, "2 hours"),
    )
    return out.filter("group_id <> '~'")


@query
def stream_messages_per_minute(i):
    flush = {"topic": "~", "partition": 0, "offset": -1}
    out = _streamed(
        i, i.messages(), "timestamp", flush, lambda s: jobs.messages_per_window(s, delay="10 minutes")
    )
    return out.filter("topic <> '~'")


@query
def stream_analysis_sinks(i):
    events = i.events()
    source, *paths = (working_dir(i.spark, f"sinks-{n}") for n in ("events", "analyses", "recommendations", "audit", "routes", "state"))
    events.write.parquet(source)
    stream = readers.stream_table(i.spark, source, events.schema)
    jobs.start_analysis_sinks(stream, *paths).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(paths[1]).drop("batch", "cli_commands")


@query
def stream_config_changes(i):
    configs = i.configs()
    # A snapshot far in the future shows that all others are whole; it stays open itself.
    end = i.spark.range(1).select(
        *[(F.lit(FLUSH) if f.name == "snapshot_at" else F.lit("0")).cast(f.dataType).alias(f.name) for f in configs.schema.fields]
    )
    source, *paths = (working_dir(i.spark, f"changes-{n}") for n in ("input", "stored", "topics", "state"))
    configs.unionByName(end).write.parquet(source)
    stream = readers.stream_table(i.spark, source, configs.schema)
    jobs.start_config_changes(stream, *paths).trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(paths[1]).drop("batch")
