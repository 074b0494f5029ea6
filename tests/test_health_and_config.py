import pytest
from pyspark.sql import functions as F

from lagscope import schemas
from lagscope.operators import config_history, health, metrics, reports

from helpers import at, naive, rows, snapshot_rows


def meta(spark, data):
    return spark.createDataFrame([(at(m), t, p, l, r, i) for m, t, p, l, r, i in data], schemas.PARTITION_METADATA)


@pytest.fixture()
def scan(spark):
    return meta(
        spark,
        [
            (0, "a", 0, 1, [1, 2], [1, 2]),
            (0, "a", 1, 1, [1, 2], [1]),
            (0, "a", 2, -1, [1, 2], [2]),
            (0, "b", 0, 2, [1, 2], [1, 2]),
            (0, "__x", 0, -1, [1, 2], [1]),
            (5, "a", 0, 2, [2, 1], [2, 1]),
        ],
    )


def test_counts_skip_offline_and_internal(scan):
    r = health.partition_health(scan).filter(F.col("scan_at") == at(0)).first()
    assert (r.total_partitions, r.offline, r.under_replicated) == (4, 1, 1)


def test_imbalance(scan):
    got = {r.scan_at: r.leader_imbalance for r in health.leader_imbalance(scan).collect()}
    assert got == {naive(0): pytest.approx(2 / 3), naive(5): 1.0}


def test_imbalance_without_leaders(spark):
    r = health.leader_imbalance(meta(spark, [(0, "a", 0, -1, [1], [])])).first()
    assert r.leader_imbalance == 0.0 and not r.is_imbalanced


def test_summary_has_leader_map(scan):
    r = health.health_summary(scan).filter(F.col("scan_at") == at(0)).first()
    assert r.broker_partition_counts == {1: 2, 2: 1}


def test_replica_views(scan):
    assert rows(health.lagging_brokers(scan), "broker_id", "out_of_sync_partitions") == [(1, 1), (2, 1)]
    assert rows(health.non_preferred_leaders(scan), "topic", "leader") == [("b", 2)]
    fair = health.leader_fair_share(scan).filter(F.col("scan_at") == at(0))
    assert rows(fair, "broker_id", "leader_count", "above_fair_share") == [(1, 2, True), (2, 1, False)]


def test_attach_health_fills_zero(spark, scan):
    cycles = spark.createDataFrame([(at(0.5),), (at(1),)], "snapshotted_at timestamp")
    out = health.attach_health(cycles, health.partition_health(scan), 60)
    assert rows(out, "snapshotted_at", "offline") == [(naive(0.5), 1), (naive(1), 0)]


def test_hotspots_and_clearing(spark):
    ends = {0: [0, 0, 0, 0], 1: [90, 2, 2, 2], 2: [100, 12, 12, 12]}
    snaps = snapshot_rows(
        spark, [("g", "t", p, 0, e, None, m) for m, row in ends.items() for p, e in enumerate(row)]
    )
    rates = health.partition_rates(snaps)
    hot = health.partition_hotspots(rates)
    assert rows(hot, "partition", "snapshotted_at") == [(0, naive(1))]
    assert hot.first().skew_factor == pytest.approx(90 / 96 * 4)
    assert health.hotspot_cleared(rates, hot).first().is_cleared
    records = spark.createDataFrame(
        [("t", 0, k) for k in ["x"] * 5 + ["y"] * 3 + ["z"]] + [("t", 1, "w")], "topic string, partition int, key string"
    )
    assert rows(health.hot_keys(records, hot, 2), "position", "key", "messages") == [(1, "x", 5), (2, "y", 3)]


def test_counter_reset_counts_from_zero(spark):
    snaps = snapshot_rows(spark, [("g", "t", 0, 0, e, None, m) for m, e in enumerate([100, 130, 20])])
    out = metrics.produce_rate(snaps, 60)
    assert rows(out, "ts", "value") == [(naive(1), 0.5), (naive(2), pytest.approx(20 / 60))]


def snaps(spark, data):
    return spark.createDataFrame([(at(m), b, t, p, r) for m, b, t, p, r in data], schemas.CONFIG_SNAPSHOT)


def test_config_deltas(spark):
    s = snaps(
        spark,
        [
            (0, 3, "a", 6, 1), (0, 3, "b", 3, 1),
            (1, 3, "a", 6, 1), (1, 3, "b", 3, 1),
            (2, 4, "a", 12, 1), (2, 4, "c", 1, 1),
        ],
    )
    assert rows(config_history.config_delta_topics(s), "topic", "change") == [("a", "CHANGED"), ("b", "REMOVED"), ("c", "NEW")]
    assert rows(config_history.config_delta_brokers(s), "brokers_before", "brokers_after") == [(3, 4)]
    summary = {r.snapshot_at: r for r in config_history.config_delta_summary(s).collect()}
    assert not summary[naive(0)].has_delta and not summary[naive(1)].has_delta
    assert summary[naive(2)].change_delta == (
        '{"broker_count":{"before":3,"after":4},"changed_topics":[{"topic":"a","before":{"name":"a","partition_count":6,'
        '"replication_factor":1},"after":{"name":"a","partition_count":12,"replication_factor":1}}],"new_topics":["c"],"removed_topics":["b"]}'
    )
    table = reports.list_cluster_configs(config_history.config_table(s), 2).collect()
    assert [(r.topic_count, r.has_changes) for r in table] == [(2, True), (2, False)]


def test_config_snapshot(spark, scan):
    brokers = spark.createDataFrame([(at(0), 1, "h", 1), (at(0), 2, "h", 1)], schemas.BROKER)
    out = config_history.config_snapshot(scan, brokers)
    assert rows(out, "topic", "partition_count", "replication_factor", "broker_count") == [
        ("a", 1, 2, 0), ("a", 3, 2, 2), ("b", 1, 2, 2)
    ]


def states(spark, values, for_minutes, bucket):
    from dataclasses import replace

    from lagscope.config import DEFAULTS

    df = spark.createDataFrame([("x", at(m), v) for m, v in values], "k string, ts timestamp, value int")
    out = metrics.alert_states(
        df, F.col("value") > 10, for_minutes * 60, ["k"], cfg=replace(DEFAULTS, bucket_seconds=bucket)
    )
    return [r.state for r in out.orderBy("ts").collect()]


@pytest.mark.parametrize("bucket", [60, 120, 300, 86_400])
def test_alert_must_hold(spark, bucket):
    values = list(enumerate([5, 20, 20, 20, 20, 5, 20, 20, 20, 5]))
    assert states(spark, values, 3, bucket) == [
        "inactive", "pending", "pending", "pending", "firing", "inactive", "pending", "pending", "pending", "inactive"
    ]
    assert states(spark, [(0, 20), (1, 20), (3, 20)], 3, bucket) == ["pending", "pending", "firing"]


def test_reports_filters_and_limits(spark):
    a = spark.createDataFrame(
        [(str(i), "SCHEDULED_POLL", at(i), "HIGH" if i % 2 else "LOW", 0.5, "s") for i in range(30)],
        "analysis_id string, triggered_by string, analyzed_at timestamp, severity string, overall_confidence double, llm_root_cause_summary string",
    )
    got = reports.list_analyses(a, severity="high").collect()
    assert len(got) == 15 and got[0].analysis_id == "29" and got[0].analyzed_at == "2024-01-01T00:29:00"
    assert len(reports.list_analyses(a).collect()) == 20
    assert reports.get_analysis(a, "nope").count() == 0
    r = spark.createDataFrame(
        [("1", 1, "r1", True), ("2", 1, "r2", False), ("9999", 1, "r3", True)],
        "analysis_id string, ordinal int, recommendation_id string, applied boolean",
    )
    assert rows(reports.list_recommendations(r, a, applied=True), "recommendation_id") == [("r1",)]


def test_running_counter(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(0)), ("a", at(900_000)), ("b", at(1))], "severity string, ts timestamp")
    out = metrics.running_counter(df, ["severity"], "ts")
    assert rows(out, "severity", "total") == [("a", 2), ("a", 3), ("b", 1)]


def test_newest_snapshots_keep_the_one_they_are_compared_with(spark):
    from lagscope.operators import config_history
    from lagscope.sources.derived import config_snapshots

    rows = [(i, i % 3, f"2024-{m:02d}-03") for m in range(1, 9) for i in range(m)]
    orders = spark.createDataFrame(rows, "o_orderkey long, c long, d string").selectExpr("o_orderkey", "c * 50 as o_custkey", "cast(d as date) as o_orderdate")
    snaps = config_snapshots(orders)
    whole = {r.snapshot_at: r.change_delta for r in config_history.config_table(snaps).collect()}
    part = {r.snapshot_at: r.change_delta for r in config_history.config_table(config_history.newest_snapshots(snaps, 3)).collect()}
    newest = sorted(whole)[-3:]
    assert len(part) == 4 and [part[k] for k in newest] == [whole[k] for k in newest]


def test_hot_keys_exact_through_task_sketches(spark):
    import random
    from collections import Counter

    from lagscope.operators import health

    rnd = random.Random(5)
    rows = [("skewed", 0, rnd.choice([1, 1, 1, 2, 2, 3]) if rnd.random() < 0.7 else rnd.randint(4, 400)) for _ in range(3000)]
    rows += [("flat", 1, rnd.randint(0, 60)) for _ in range(2000)]
    rows += [("flat", 1, None)] * 90 + [("few", 2, 7)] * 3 + [("cold", 3, 1)] * 50
    records = spark.createDataFrame(rows, "topic string, partition int, key long").repartition(7)
    hotspots = spark.createDataFrame([("skewed", 0), ("flat", 1), ("few", 2), ("few", 2)], "topic string, partition int")
    expected = []
    for part in (("skewed", 0), ("flat", 1), ("few", 2)):
        c = Counter(r[2] for r in rows if r[:2] == part)
        best = sorted(c.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:4]
        expected += [(*part, key, n, i + 1) for i, (key, n) in enumerate(best)]
    for keep in (2, 4, 1000):
        got = health.hot_keys(records, hotspots, k=4, keep=keep).select("topic", "partition", "key", "messages", "position").collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
