import json

from pyspark.sql import functions as F

from lagscope import schemas, session
from lagscope.operators import recommend
from lagscope.plans.cycle import lag_cycle
from lagscope.sources import readers, sinks

from helpers import at, rows, snapshot_rows


def scored(spark, data):
    df = spark.createDataFrame(
        data, "group_id string, topic string, lag_classification string, severity_score double"
    )
    return df.select(
        "*", F.lit(at(0)).alias("snapshotted_at"), F.lit(1234567).cast("bigint").alias("total_lag"),
        F.lit(-0.4).alias("lag_velocity_per_min"), F.col("severity_score").alias("group_score"),
    )


def health(spark, under=0, imbalance=0.0, offline=0):
    return spark.createDataFrame(
        [(at(0), 10, under, offline, imbalance, "HIGH")],
        "snapshotted_at timestamp, total_partitions bigint, under_replicated bigint, offline bigint, leader_imbalance double, severity string",
    )


def test_rules_and_order(spark):
    t = scored(spark, [("g1", "a", "STALLED_CONSUMER", 1.0), ("g1", "b", "GROWING_LAG", 0.9), ("g0", "c", "THUNDERING_HERD", 0.5)])
    r = recommend.ranked_recs(
        recommend.heuristic_topic_recs(t), recommend.heuristic_cluster_recs(health(spark, under=3, imbalance=0.41))
    ).orderBy("ordinal").collect()
    assert [(x.ordinal, x.position, x.recommendation_type, x.estimated_resolution_minutes) for x in r] == [
        (1, 1, "BROKER_HEALTH_CHECK", 30), (2, 2, "CONSUMER_RESTART", 5),
        (3, 3, "CONSUMER_SCALE_OUT", 15), (4, 4, "PREFERRED_REPLICA_ELECTION", 5),
    ]
    assert r[0].rationale == "3 under-replicated partitions; check broker disk/network."
    assert r[1].rationale == "Consumer group g1 has stalled on a."
    assert r[3].cli_commands == [recommend.ELECTION_COMMAND] and r[1].cli_commands == []
    assert recommend.heuristic_cluster_recs(health(spark, imbalance=0.4)).count() == 0


def test_model_output_validation(spark):
    full = {"recommendation_type": "MESSAGE_SKIP", "priority": "IMMEDIATE", "rationale": "r", "risk_level": "HIGH",
            "grounding": "RUNBOOK", "cli_commands": ["x"], "estimated_resolution_minutes": 7}
    out = {
        "a": json.dumps({"root_cause_summary": "s", "recommendations": [full, {}, {**full, "priority": "NOW"}], "confidence": 0.9}),
        "b": "{broken",
        "c": json.dumps({"recommendations": []}),
    }
    raw = spark.createDataFrame(list(out.items()), "analysis_id string, output string")
    valid, rejected = recommend.validate_recs(raw)
    v = valid.orderBy("item_no").collect()
    assert [(r.analysis_id, r.recommendation_type, r.priority, r.estimated_resolution_minutes, r.cli_commands) for r in v] == [
        ("a", "MESSAGE_SKIP", "IMMEDIATE", 7, ["x"]), ("a", "CONFIG_CHANGE", "ADVISORY", 15, [])
    ]
    assert rows(rejected, "analysis_id", "rejected_for") == [("a", "priority"), ("b", "output")]


def test_context_text(spark):
    t = scored(spark, [("g1", "a", "GROWING_LAG", 0.876)]).withColumn("problematic_partitions", F.array(F.lit(1), F.lit(4)))
    text = recommend.analysis_context(t, health(spark, under=2, imbalance=0.4567)).first().context
    assert text == (
        "## Consumer Group Lag Analysis\n"
        "\n### Group: g1 (severity=0.88)\n"
        "  - topic=a lag=1,234,567 velocity=-0/min classification=GROWING_LAG\n"
        "    problematic partitions: [1, 4]\n"
        "\n## Partition Health\n  total=10\n  under_replicated=2\n  offline=0\n  leader_imbalance=45.7%\n"
        "\n## Similar Historical Incidents: none found"
    )


def test_large_cycles_are_split_and_whole(spark):
    t = scored(spark, [(f"g{i // 5}", f"t{i:03d}", "GROWING_LAG", 1.0) for i in range(53)])
    recs = recommend.ranked_recs(recommend.heuristic_topic_recs(t), recommend.heuristic_cluster_recs(health(spark, under=1)))
    events = recommend.analysis_events(health(spark, under=1), t, recs, part_rows=10)
    got = events.collect()
    assert sorted(e.part for e in got) == list(range(6)) and len({e.analysis_id for e in got}) == 1
    topics = sorted(x.topic for e in got for g in e.consumer_groups for x in g.topics)
    assert topics == [f"t{i:03d}" for i in range(53)]
    assert all(sum(len(g.topics) for g in e.consumer_groups) <= 10 for e in got)
    assert recommend.recommendation_rows(events).count() == 54
    texts = recommend.analysis_context(t, health(spark), part_rows=10).orderBy("part").collect()
    assert len(texts) == 6 and sum(x.context.count("  - topic=") for x in texts) == 53
    assert texts[0].context.startswith("## Consumer Group") and "Partition Health" in texts[-1].context
    assert not any("Partition Health" in x.context for x in texts[:-1])


def test_cycle_without_lag_but_with_faults(spark):
    snaps = snapshot_rows(spark, [("g", "t", 0, 5, 5, None, 0)])
    meta = spark.createDataFrame([(at(0), "t", 0, -1, [1, 2], [1])], schemas.PARTITION_METADATA)
    c = lag_cycle(snaps, meta)
    assert rows(c.cycles, "severity", "offline") == [("CRITICAL", 1)]
    e = recommend.analysis_events(c.cycles, c.topics, c.recommendations).first()
    assert e.consumer_groups == [] and e.recommendations == []


def test_duplicate_worst_group_keeps_the_cycle(spark):
    snaps = snapshot_rows(spark, [("g", "t", 0, 0, 5000 * (m + 1), None, m) for m in range(4)])
    meta = spark.createDataFrame([(at(3), "t", 0, -1, [1, 2], [1])], schemas.PARTITION_METADATA)
    c = lag_cycle(snaps, meta)
    assert c.worst.count() < c.cycles.count()
    quiet = lag_cycle(snaps, meta, suppress_cycle=True)
    assert quiet.cycles.count() == quiet.worst.count()


def test_json_dead_letter(spark):
    data = [("t", 0, i, "k", v, at(0)) for i, v in enumerate(['{"event_id": "1"}', "{bad", None, '{"event_id": 5, "x": 1}'])]
    msgs = spark.createDataFrame(data, schemas.RAW_MESSAGE)
    from pyspark.sql import types as T

    good, bad = readers.parse_json(msgs, T.StructType([T.StructField("event_id", T.StringType())]))
    assert rows(good, "offset") == [(0,), (3,)]
    assert rows(bad, "offset", "error") == [(1, "malformed JSON"), (2, "missing value")]


def test_poison_messages(spark):
    data = [("orders", 0, i, "k", v, at(0)) for i, v in enumerate(['{"a": 1}', "{bad", None, '{"a": "' + "x" * 2000 + '"}', "{bad"])]
    msgs = spark.createDataFrame(data, schemas.RAW_MESSAGE)
    stuck = spark.createDataFrame([("g", "orders", 0, i) for i in range(4)], "group_id string, topic string, partition int, committed_offset bigint")
    assert rows(readers.poison_messages(msgs, stuck), "offset", "reason") == [(1, "malformed JSON"), (2, "missing value"), (3, "oversized")]


def test_insert_ignore_and_upsert(spark, monkeypatch):
    new = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("c", 1)], "id string, n int")
    old = spark.createDataFrame([("b", 9)], "id string, n int")
    assert rows(sinks.insert_ignore(new, old, "id", ["n"]), "id", "n") == [("a", 1), ("c", 1)]
    many = spark.range(2_000).selectExpr("cast(id % 1000 as string) as id", "cast(id as int) as n", "repeat('v', 20) as v")
    held = many.filter("id < 100")
    plain = rows(sinks.insert_ignore(many, held, "id", ["n"]), "id", "n", "v")
    with monkeypatch.context() as patch:
        patch.setattr(session.tasks_for, "__defaults__", (100,))
        dealt = sinks.insert_ignore(many, held, "id", ["n"], size=2_000)
        assert rows(dealt, "id", "n", "v") == plain and len(plain) == 900
        assert dealt.select(F.spark_partition_id()).distinct().count() == 20
    stored = spark.createDataFrame([(1, "x", 5), (2, "y", 1)], "id int, v string, version int")
    fresh = spark.createDataFrame([(1, "z", 4), (2, "w", 1), (3, "n", 0)], "id int, v string, version int")
    assert rows(sinks.vector_upsert(stored, fresh), "id", "v") == [(1, "x"), (2, "w"), (3, "n")]


def test_snapshot_sink_prunes_by_day(spark, tmp_path):
    df = snapshot_rows(spark, [("g", "t", 0, 0, 1, None, m) for m in (0, 10, 2000)])
    sinks.append_snapshots(df, str(tmp_path / "s"))
    sinks.append_snapshots(df.limit(1), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 4 and back.select("snapshot_date").distinct().count() == 2


def test_routes(spark):
    e = spark.createDataFrame([("e1", []), ("e2", ["r"])], "analysis_id string, recommendations array<string>")
    assert rows(sinks.publish_routes(e), "key", "topic") == [
        ("e1", "kafka.ops.analysis.completed"), ("e2", "kafka.ops.analysis.completed"), ("e2", "kafka.ops.scaling.recommended"),
    ]


def test_each_message_is_parsed_once(spark):
    from pyspark.sql import types as T

    msgs = spark.createDataFrame([("t", 0, 0, "k", "{}", at(0))], schemas.RAW_MESSAGE)
    for part in readers.parse_json(msgs, T.StructType([T.StructField("a", T.StringType())])):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, plan
