"""Rule-based recommendations, checks of model-made ones, and analysis events.

Whatever gathers rows of a cycle into one row (texts and events) does so in parts of at most
``part_rows`` topics, so no row grows with the size of the cluster. A cycle of up to that many
topics has one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..config import DEFAULTS, Thresholds
from ..functions.columns import priority_rank
from ..functions.timeline import numbered
from ..schemas import MODEL_OUTPUT

PART_ROWS = 1000
RUNBOOK_CHARS = 800

REC_COLUMNS = [
    "recommendation_type",
    "priority",
    "rationale",
    "risk_level",
    "grounding",
    "consumer_group",
    "topic",
    "estimated_resolution_minutes",
    "cli_commands",
]

# Fixed value: the command that goes with a preferred-replica election.
ELECTION_COMMAND = (
    "kafka-leader-election --bootstrap-server localhost:9092 "
    "--election-type PREFERRED --all-topic-partitions"
)


def _rec(
    stage: int,
    kind: str,
    priority: str,
    rationale: Column,
    risk: str,
    minutes: int,
    group: Column | None = None,
    topic: Column | None = None,
    commands: tuple[str, ...] = (),
) -> Column:
    none = F.lit(None).cast("string")
    cli = F.array(*[F.lit(c) for c in commands]) if commands else F.array().cast("array<string>")
    return F.struct(
        F.lit(stage).alias("stage"),
        F.lit(kind).alias("recommendation_type"),
        F.lit(priority).alias("priority"),
        rationale.alias("rationale"),
        F.lit(risk).alias("risk_level"),
        F.lit("HEURISTIC_ONLY").alias("grounding"),
        (none if group is None else group).alias("consumer_group"),
        (none if topic is None else topic).alias("topic"),
        F.lit(minutes).alias("estimated_resolution_minutes"),
        cli.alias("cli_commands"),
    )


def heuristic_topic_recs(scored: DataFrame) -> DataFrame:
    """A restart for stalled topics, more consumers for growing ones; no shuffle."""
    group, topic = F.col("group_id"), F.col("topic")
    restart = _rec(
        1, "CONSUMER_RESTART", "IMMEDIATE",
        F.format_string("Consumer group %s has stalled on %s.", group, topic), "LOW", 5, group, topic,
    )
    scale = _rec(
        1, "CONSUMER_SCALE_OUT", "WITHIN_15MIN",
        F.format_string("Growing lag on %s; increase consumer instances.", topic), "MEDIUM", 15, group, topic,
    )
    return (
        scored.filter(F.col("lag_classification").isin(C.STALLED, C.GROWING))
        .select(
            "snapshotted_at",
            F.when(F.col("lag_classification") == C.STALLED, restart).otherwise(scale).alias("r"),
        )
        .select("snapshotted_at", "r.*")
    )


def heuristic_cluster_recs(health: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """A broker check for under-replicated partitions (stage 0, goes first), an election for
    leader imbalance (stage 2, goes last). ``health`` has snapshotted_at, under_replicated and
    leader_imbalance."""
    check = _rec(
        0, "BROKER_HEALTH_CHECK", "IMMEDIATE",
        F.format_string(
            "%d under-replicated partitions; check broker disk/network.", F.col("under_replicated").cast("bigint")
        ),
        "CRITICAL", 30,
    )
    election = _rec(
        2, "PREFERRED_REPLICA_ELECTION", "WITHIN_1HOUR",
        F.lit("Leader imbalance exceeds 40%; trigger preferred replica election."),
        "LOW", 5, commands=(ELECTION_COMMAND,),
    )
    made = F.array_compact(
        F.array(
            F.when(F.col("under_replicated") > 0, check),
            F.when(F.col("leader_imbalance") > cfg.imbalance_share, election),
        )
    )
    return health.select("snapshotted_at", F.explode(made).alias("r")).select("snapshotted_at", "r.*")


def ranked_recs(topic_recs: DataFrame, cluster_recs: DataFrame) -> DataFrame:
    """All recommendations of a cycle: ``ordinal`` in the order of the rules, ``position`` by
    priority."""
    both = topic_recs.unionByName(cluster_recs).withColumn("_p", priority_rank("priority"))
    keyed = both.withColumn("_g", F.coalesce("consumer_group", F.lit(""))).withColumn(
        "_t", F.coalesce("topic", F.lit(""))
    )
    ordered = numbered(keyed, ["snapshotted_at"], ["stage", "_g"], ["_t"], "ordinal")
    ranked = numbered(ordered, ["snapshotted_at"], ["_p", "stage", "_g"], ["_t"], "position")
    return ranked.select("snapshotted_at", "ordinal", "position", *REC_COLUMNS)


# ---------------------------------------------------------------- model output


def validate_recs(raw: DataFrame, column: str = "output") -> tuple[DataFrame, DataFrame]:
    """Split the recommendations in JSON model output into valid and rejected ones.

    Missing fields get their defaults; a value outside its enumeration rejects the one
    recommendation it is in. Output that is no JSON object is rejected as a whole.
    """
    others = [c for c in raw.columns if c != column]
    parsed = raw.select(
        *others, column, F.from_json(column, MODEL_OUTPUT, {"mode": "PERMISSIVE"}).alias("m")
    )
    # Only output that gave nothing is parsed again, to tell an empty object from broken text.
    nothing = F.coalesce(
        F.col("m.root_cause_summary").cast("string"),
        F.col("m.confidence").cast("string"),
        F.when(F.col("m.recommendations").isNotNull(), ""),
    ).isNull()
    parsed = parsed.withColumn(
        "broken", F.when(nothing, F.try_parse_json(F.col(column)).isNull()).otherwise(False)
    )
    rows = parsed.select(
        *others,
        "broken",
        F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"),
        F.posexplode_outer("m.recommendations").alias("item_no", "r"),
    )

    def field(name: str, default) -> Column:
        value = F.col(f"r.{name}")
        return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)

    filled = rows.select(
        *others,
        "broken",
        "item_no",
        "confidence",
        field("recommendation_type", "CONFIG_CHANGE"),
        field("priority", "ADVISORY"),
        field("rationale", ""),
        field("risk_level", "MEDIUM"),
        field("grounding", "HEURISTIC_ONLY"),
        field("consumer_group", None),
        field("topic", None),
        field("estimated_resolution_minutes", 15),
        F.coalesce("r.cli_commands", F.array().cast("array<string>")).alias("cli_commands"),
    )
    problem = (
        F.when(F.col("broken"), "output")
        .when(~F.col("recommendation_type").isin(*C.RECOMMENDATION_TYPES), "recommendation_type")
        .when(~F.col("priority").isin(*C.PRIORITIES), "priority")
        .when(~F.col("risk_level").isin(*C.RISK_LEVELS), "risk_level")
        .when(~F.col("grounding").isin(*C.GROUNDINGS), "grounding")
    )
    checked = filled.withColumn("rejected_for", problem).drop("broken")
    valid = checked.filter("rejected_for is null and item_no is not null").drop("rejected_for")
    return valid, checked.filter("rejected_for is not null")


def model_results(raw: DataFrame, column: str = "output") -> DataFrame:
    """Summary and confidence of each output that is a JSON object; other output is left out, so
    that the rules answer in its place. ``raw`` has one output per row of its other columns."""
    others = [c for c in raw.columns if c != column]
    usable = F.try_parse_json(column).isNotNull()
    parsed = raw.filter(usable & F.col(column).rlike(r"^\s*\{")).select(
        *others, F.from_json(column, MODEL_OUTPUT, {"mode": "PERMISSIVE"}).alias("m")
    )
    return parsed.select(
        *others,
        F.coalesce("m.root_cause_summary", F.lit("")).alias("root_cause_summary"),
        F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"),
    )


def choose_recs(heuristic: DataFrame, valid: DataFrame, results: DataFrame) -> DataFrame:
    """Recommendations of each cycle: the model's where it answered, else those of the rules.

    ``heuristic``: ``ranked_recs``; ``valid``: the valid ones of ``validate_recs`` and ``results``:
    ``model_results``, both by ``snapshotted_at``.
    """
    answered = results.select("snapshotted_at")
    model = valid.select("snapshotted_at", (F.col("item_no") + 1).cast("bigint").alias("ordinal"), *REC_COLUMNS)
    rules = heuristic.join(answered, "snapshotted_at", "left_anti").select(
        "snapshotted_at", F.col("ordinal").cast("bigint").alias("ordinal"), *REC_COLUMNS
    )
    return rules.unionByName(model)


# ---------------------------------------------------------------- texts and events


def _parts(topics: DataFrame, part_rows: int) -> DataFrame:
    placed = numbered(topics, ["snapshotted_at"], ["group_id"], ["topic"], "_n")
    return placed.withColumn("part", F.expr(f"cast((_n - 1) div {part_rows} as int)"))


def analysis_context(
    topics: DataFrame,
    health: DataFrame,
    incidents: DataFrame | None = None,
    runbooks: DataFrame | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Text report of each cycle.

    ``topics``: scored topics with ``group_score`` and optionally ``problematic_partitions``;
    ``health``: one row per cycle (total_partitions, under_replicated, offline,
    leader_imbalance, and ``hotspot_partitions`` where known); ``incidents`` and ``runbooks``: search results per snapshotted_at with
    ``position``. Health and search results close the last part.
    """
    def signed(value: Column) -> Column:
        whole = F.bround(value, 0).cast("bigint")
        return F.when((value < 0) & (whole == 0), "-0").otherwise(F.format_string("%+d", whole))

    line = F.concat(
        F.lit("  - topic="), F.col("topic"),
        F.lit(" lag="), F.format_number("total_lag", 0),
        F.lit(" velocity="), signed(F.col("lag_velocity_per_min")), F.lit("/min"),
        F.lit(" classification="), F.col("lag_classification"),
    )
    if "problematic_partitions" in topics.columns:
        listed = F.array_join(F.transform("problematic_partitions", lambda p: p.cast("string")), ", ")
        line = F.when(
            F.size("problematic_partitions") > 0,
            F.concat(line, F.lit("\n    problematic partitions: ["), listed, F.lit("]")),
        ).otherwise(line)
    parts = _parts(topics, part_rows)
    per_group = parts.groupBy("snapshotted_at", "part", "group_id").agg(
        F.first("group_score").alias("s"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("topic", line.alias("line")))), lambda x: x["line"]), "\n"
        ).alias("lines"),
    )
    block = F.concat(
        F.lit("\n### Group: "), F.col("group_id"), F.format_string(" (severity=%.2f)\n", "s"), F.col("lines")
    )
    per_part = per_group.groupBy("snapshotted_at", "part").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("group_id", block.alias("b")))), lambda x: x["b"]), "\n"
        ).alias("groups")
    )
    last = per_part.groupBy("snapshotted_at").agg(F.max("part").alias("last_part"))

    hotspots = F.lit("")
    if "hotspot_partitions" in health.columns:
        pairs = F.transform(
            "hotspot_partitions",
            lambda h: F.concat(F.lit("('"), h["topic"], F.lit("', "), h["partition"].cast("string"), F.lit(")")),
        )
        hotspots = F.when(
            F.size("hotspot_partitions") > 0,
            F.concat(F.lit("\n  hotspots: ["), F.array_join(pairs, ", "), F.lit("]")),
        ).otherwise("")
    tail = health.select(
        "snapshotted_at",
        F.concat(
            F.lit("\n## Partition Health\n  total="), F.col("total_partitions").cast("string"),
            F.lit("\n  under_replicated="), F.col("under_replicated").cast("string"),
            F.lit("\n  offline="), F.col("offline").cast("string"),
            F.format_string("\n  leader_imbalance=%.1f%%", F.col("leader_imbalance") * 100),
            hotspots,
        ).alias("health_text"),
    )
    out = (
        tail.join(per_part, "snapshotted_at", "left")
        .join(last, "snapshotted_at", "left")
        .fillna({"part": 0, "last_part": 0})
    )

    no_hits = "\n## Similar Historical Incidents: none found"
    if incidents is not None:
        entry = F.concat(
            F.lit("  - ["), F.col("incident_id"), F.lit("] "), F.col("lag_classification"),
            F.lit(" resolved_by="), F.col("resolution_type"),
            F.lit(" in "), F.col("time_to_resolution_minutes").cast("string"),
            F.format_string("min (similarity=%.2f)", "similarity_score"),
            F.when(F.col("summary") != "", F.concat(F.lit("\n    summary: "), F.col("summary"))).otherwise(""),
        )
        listed = incidents.groupBy("snapshotted_at").agg(_joined(entry).alias("i"))
        out = out.join(listed, "snapshotted_at", "left").withColumn(
            "incident_text",
            F.coalesce(F.concat(F.lit("\n## Similar Historical Incidents (RAG)\n"), F.col("i")), F.lit(no_hits)),
        )
    else:
        out = out.withColumn("incident_text", F.lit(no_hits))
    if runbooks is not None:
        entry = F.concat(
            F.lit("\n### "), F.col("title"), F.lit(" — "), F.col("section"), F.lit("\n"),
            F.substring("content", 1, RUNBOOK_CHARS),
        )
        listed = runbooks.groupBy("snapshotted_at").agg(_joined(entry).alias("r"))
        out = out.join(listed, "snapshotted_at", "left").withColumn(
            "runbook_text", F.coalesce(F.concat(F.lit("\n\n## Relevant Runbook Sections\n"), F.col("r")), F.lit(""))
        )
    else:
        out = out.withColumn("runbook_text", F.lit(""))

    closing = F.concat(
        F.lit("\n"), F.col("health_text"), F.lit("\n"), F.col("incident_text"), F.col("runbook_text")
    )
    return out.select(
        "snapshotted_at",
        "part",
        F.concat(
            F.when(F.col("part") == 0, "## Consumer Group Lag Analysis").otherwise(""),
            F.coalesce(F.concat(F.lit("\n"), F.col("groups")), F.lit("")),
            F.when(F.col("part") == F.col("last_part"), closing).otherwise(""),
        ).alias("context"),
    )


def _joined(entry: Column) -> Column:
    """Lines of a search result in order; there are as many as the search returns."""
    rows = F.sort_array(F.collect_list(F.struct("position", entry.alias("e"))))
    return F.array_join(F.transform(rows, lambda x: x["e"]), "\n")


def analysis_id(ts: str = "snapshotted_at") -> Column:
    """The same id for the same cycle, however often it is computed; in UUID form."""
    h = F.md5(F.concat(F.lit("SCHEDULED_POLL:"), F.unix_micros(ts).cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def analysis_events(
    cycles: DataFrame,
    topics: DataFrame,
    recs: DataFrame,
    incidents: DataFrame | None = None,
    runbooks: DataFrame | None = None,
    part_rows: int = PART_ROWS,
    results: DataFrame | None = None,
) -> DataFrame:
    """Nested analysis events of each cycle.

    ``cycles``: one row per actionable cycle with severity and health; ``topics``: scored topics
    of its high groups with ``group_score``; ``recs``: ranked or chosen recommendations; ``results``:
    ``model_results``, whose summary and confidence go into the event. An event carries
    at most ``part_rows`` topics and as many recommendations; a larger cycle has several parts
    under the same analysis id.
    """
    topic = F.struct(
        "topic", "total_lag", "lag_velocity_per_min", "lag_classification", "severity_score"
    )
    groups = (
        _parts(topics, part_rows)
        .groupBy("snapshotted_at", "part", "group_id")
        .agg(F.first("group_score").alias("severity_score"), F.sort_array(F.collect_list(topic)).alias("topics"))
        .groupBy("snapshotted_at", "part")
        .agg(F.sort_array(F.collect_list(F.struct("group_id", "severity_score", "topics"))).alias("consumer_groups"))
    )
    rec_lists = (
        recs.withColumn("part", F.expr(f"cast((ordinal - 1) div {part_rows} as int)"))
        .groupBy("snapshotted_at", "part")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", *REC_COLUMNS))).alias("recommendations"))
    )
    first = cycles.select("snapshotted_at", F.lit(0).alias("part"))
    bodies = groups.join(rec_lists, ["snapshotted_at", "part"], "full_outer").join(
        first, ["snapshotted_at", "part"], "full_outer"
    )
    out = cycles.join(bodies, "snapshotted_at")

    def attach(out: DataFrame, hits: DataFrame | None, fields: list[str], name: str, ddl: str) -> DataFrame:
        if hits is None:
            return out.withColumn(name, F.array().cast(ddl))
        listed = hits.groupBy("snapshotted_at").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("v")))), lambda x: x["v"]
            ).alias("_l")
        )
        return (
            out.join(listed, "snapshotted_at", "left")
            .withColumn(name, F.coalesce("_l", F.array().cast(ddl)))
            .drop("_l")
        )

    out = attach(
        out, incidents,
        ["incident_id", "similarity_score", "lag_classification", "resolution_type"],
        "similar_incidents",
        "array<struct<incident_id:string,similarity_score:double,lag_classification:string,resolution_type:string>>",
    )
    out = attach(
        out, runbooks, ["runbook_id", "title", "section", "relevance_score"], "runbook_references",
        "array<struct<runbook_id:string,title:string,section:string,relevance_score:double>>",
    )
    if results is None:
        out = out.withColumn("root_cause_summary", F.lit("")).withColumn("confidence", F.lit(0.0))
    else:
        out = out.join(results, "snapshotted_at", "left")
    health = [c for c in ("total_partitions", "under_replicated", "offline", "leader_imbalance") if c in cycles.columns]
    return out.select(
        analysis_id().alias("analysis_id"),
        "part",
        F.lit("SCHEDULED_POLL").alias("triggered_by"),
        F.col("snapshotted_at").alias("analyzed_at"),
        "severity",
        F.coalesce("root_cause_summary", F.lit("")).alias("llm_root_cause_summary"),
        F.coalesce("confidence", F.lit(0.0)).alias("overall_confidence"),
        F.struct(*health).alias("partition_health"),
        F.coalesce("consumer_groups", F.array()).alias("consumer_groups"),
        "similar_incidents",
        "runbook_references",
        F.coalesce("recommendations", F.array()).alias("recommendations"),
    )


def recommendation_rows(events: DataFrame) -> DataFrame:
    """One row per recommendation, as stored."""
    return events.select(
        "analysis_id", F.col("analyzed_at").alias("created_at"), F.explode("recommendations").alias("r")
    ).select("analysis_id", "r.*", F.lit(False).alias("applied"), "created_at")


def reference_ids(events: DataFrame) -> DataFrame:
    """Ids of the incidents and runbooks each event refers to."""
    return events.select(
        "analysis_id",
        "part",
        F.transform("similar_incidents", lambda x: x["incident_id"]).alias("similar_incidents"),
        F.transform("runbook_references", lambda x: x["runbook_id"]).alias("runbook_references"),
    )
