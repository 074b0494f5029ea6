import itertools
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lagscope import config as C
from lagscope.config import DEFAULTS
from lagscope.operators import lag

from helpers import at, naive, rows, snapshot_rows


def classified(spark, total, velocity, *, parts=4, lagging=4, stalled=0, top=None):
    row = [(total, float(velocity), parts, lagging, stalled, top if top is not None else total // max(lagging, 1))]
    df = spark.createDataFrame(
        row,
        "total_lag bigint, lag_velocity_per_min double, partition_rows bigint, lagging_partitions bigint,"
        " stalled_count bigint, max_lag bigint",
    )
    r = lag.score(lag.classify(df)).first()
    return r.lag_classification, r.severity_score


def test_clamp_and_raw_lag(spark):
    df = snapshot_rows(
        spark,
        [
            ("g", "t", 0, -5, 10, None, 0),
            ("g", "t", 1, 20, 15, None, 0),
            ("g", "t", 2, 7, None, None, 0),
            ("g", "__offsets", 0, 0, 9, None, 0),
            ("g", "kafka.ops.x", 0, 0, 9, None, 0),
        ],
    )
    out = lag.lag_by_partition(df)
    assert rows(out, "partition", "committed_offset", "log_end_offset", "lag", "lag_raw") == [
        (0, 0, 10, 10, 10),
        (1, 20, 15, 0, -5),
        (2, 7, 7, 0, 0),
    ]
    assert lag.lag_by_partition(df, keep_zero=False).count() == 1


@pytest.mark.parametrize(
    "velocity,total,expected",
    [
        (-100.5, 1000, C.CATCHUP),
        (-100, 1000, C.CATCHUP),
        (-50, 60_000, C.CATCHUP),
        (-49, 60_000, C.HERD),
        (0, 50_000, C.CATCHUP),
        (0, 50_001, C.HERD),
        (49.9, 60_000, C.HERD),
        (50, 60_000, C.GROWING),
        (500, 1000, C.GROWING),
        (501, 1000, C.GROWING),
        (1, 10, C.GROWING),
        (0, 10, C.CATCHUP),
        (0, 0, C.HEALTHY),
    ],
)
def test_velocity_rules(spark, velocity, total, expected):
    assert classified(spark, total, velocity)[0] == expected


def test_stall_rules_come_first(spark):
    assert classified(spark, 100, 900, stalled=4)[0] == C.STALLED
    assert classified(spark, 100, 900, stalled=1)[0] == C.SINGLE_STALL
    assert classified(spark, 0, 0, stalled=4, lagging=0)[0] == C.HEALTHY


def test_skew_rule_needs_seven_partitions(spark):
    # Six lagging partitions and one without lag; the top one holds more than 5 averages.
    assert classified(spark, 1000, 0, parts=7, lagging=6, top=900)[0] == C.SINGLE_STALL
    assert classified(spark, 1000, 0, parts=6, lagging=6, top=900)[0] == C.CATCHUP
    assert classified(spark, 1000, 0, parts=7, lagging=6, top=833)[0] == C.CATCHUP


def test_score_formula_and_clamp(spark):
    assert classified(spark, 82_000, 450)[1] == 1.0
    assert classified(spark, 100, 1)[1] == pytest.approx(math.log10(100) / 6 * 1.5)
    assert classified(spark, 1, 1)[1] == 0.0
    assert classified(spark, 0, 0)[1] == 0.0
    assert classified(spark, 1_000_000, -200)[1] == pytest.approx(0.5)


@pytest.mark.parametrize(
    "value,name", [(0.7, "CRITICAL"), (0.699, "HIGH"), (0.4, "HIGH"), (0.399, "MEDIUM"), (0.2, "MEDIUM"), (0.199, "LOW")]
)
def test_severity_edges(spark, value, name):
    df = spark.createDataFrame([(value,)], "severity_score double")
    assert lag.with_severity(df).first().severity == name


def series(spark, points, partitions=1):
    """Snapshots with the given (minute, lag per partition)."""
    return snapshot_rows(
        spark, [("g", "t", p, 0, v, None, m) for m, v in points for p in range(partitions)]
    )


def velocities(spark, df, cfg=DEFAULTS):
    v = lag.with_velocity(lag.topic_lag(lag.lag_by_partition(df)), cfg)
    return {r.snapshotted_at: r.lag_velocity_per_min for r in v.collect()}


def test_velocity_window_is_strict_and_counts_rows(spark):
    one = velocities(spark, series(spark, [(0, 100), (5, 600)]))
    assert one[naive(5)] == 0.0  # a single history row is not enough
    two = velocities(spark, series(spark, [(0, 100), (5, 600)], partitions=2))
    assert two[naive(5)] == pytest.approx((1200 - 200) / 5)
    old = velocities(spark, series(spark, [(0, 0), (10, 500), (11, 700)], partitions=2))
    assert old[naive(10)] == 0.0  # exactly as old as the period is out
    assert old[naive(11)] == pytest.approx((1400 - 1000) / 1)
    close = velocities(spark, series(spark, [(0, 100), (0.4, 600)], partitions=2))
    assert close[naive(0.4)] == 0.0
    half = velocities(spark, series(spark, [(0, 100), (0.5, 600)], partitions=2))
    assert half[naive(0.5)] == pytest.approx(2000)


def test_velocity_uses_raw_history(spark):
    df = snapshot_rows(
        spark,
        [("g", "t", 0, 50, 20, None, 0), ("g", "t", 1, 0, 40, None, 0), ("g", "t", 0, 0, 60, None, 2), ("g", "t", 1, 0, 40, None, 2)],
    )
    assert velocities(spark, df)[naive(2)] == pytest.approx((100 - 10) / 2)


def test_zero_history_flag(spark):
    df = series(spark, [(0, 0), (2, 100), (4, 200)], partitions=2)
    assert velocities(spark, df)[naive(4)] == pytest.approx(400 / 4)
    assert velocities(spark, df, replace(DEFAULTS, drop_zero_lag_history=True))[naive(4)] == pytest.approx(200 / 2)


def test_slices_do_not_change_velocity(spark):
    rnd = random.Random(3)
    df = series(spark, [(m, rnd.randrange(1000)) for m in range(0, 120, 2)], partitions=2)
    whole = velocities(spark, df)
    for seconds in (600, 660, 1800):
        assert velocities(spark, df, replace(DEFAULTS, bucket_seconds=seconds)) == whole


def test_last_commit_from_offsets(spark):
    df = snapshot_rows(spark, [("g", "t", 0, c, 100, None, m) for m, c in enumerate([5, 5, 7, 7, 7, 9, 5, 5])])
    expected = [None, None, 2, 2, 2, 5, 6, 6]
    for seconds in (60, 120, 180, 86_400):
        out = lag.with_last_commit(df, replace(DEFAULTS, bucket_seconds=seconds))
        got = [r.last_commit_at for r in out.orderBy("snapshotted_at").collect()]
        assert got == [None if m is None else naive(m) for m in expected], seconds


def test_stalled_boundary(spark):
    df = snapshot_rows(spark, [("g", "t", 0, 0, 9, 0, 10), ("g", "t", 1, 0, 9, 0, 10.1), ("g", "t", 2, 0, 9, None, 99)])
    assert rows(lag.stalled_partitions(lag.lag_by_partition(df)), "partition") == [(1,)]


def test_problematic_partitions(spark):
    df = snapshot_rows(spark, [("g", "t", p, 0, e, None, 0) for p, e in enumerate([100, 0, 0, 0, 1])])
    lags = lag.lag_by_partition(df)
    assert rows(lag.problematic_partitions(lags), "partition", "lag") == [(0, 100)]
    d = lag.topic_details(lags, lag.analyze_topics(df)).first()
    assert d.problematic_partitions == [0] and len(d.partitions) == 5


def test_worst_group_and_ties(spark):
    df = spark.createDataFrame(
        [("b", "t1", 0.9), ("a", "t2", 0.9), ("a", "t1", 0.9), ("c", "t9", 0.3)],
        "group_id string, topic string, severity_score double",
    ).select(
        "*", F.lit(at(0)).alias("snapshotted_at"), F.lit("GROWING_LAG").alias("lag_classification"),
        F.lit(1).alias("total_lag"), F.lit(0.0).alias("lag_velocity_per_min"),
    )
    r = lag.worst_group_topic(df).collect()
    assert [(x.group_id, x.topic) for x in r] == [("a", "t1")]
    assert lag.worst_group_topic(df.filter("severity_score < 0.4")).count() == 0


def test_cycles_gate_and_escalation(spark):
    cycles = spark.createDataFrame(
        [(0, 0.0, 0, 0), (1, 0.5, 0, 0), (0, 0.0, 0, 2), (0, 0.0, 1, 0)],
        "high_groups int, max_score double, offline int, under_replicated int",
    )
    out = lag.cycle_severity(lag.actionable_cycles(cycles))
    assert sorted(r.severity for r in out.collect()) == ["CRITICAL", "CRITICAL", "HIGH"]


def test_catch_up_is_null_when_falling_behind(spark):
    df = snapshot_rows(
        spark,
        [("g", "t", 0, c, e, None, m) for m, c, e in [(0, 0, 100), (1, 60, 120), (2, 70, 200)]],
    )
    out = lag.catch_up(lag.topic_lag(lag.lag_by_partition(df))).orderBy("snapshotted_at").collect()
    assert out[0].catch_up_minutes == pytest.approx(60 / 40)
    assert out[1].catch_up_minutes is None


def test_reset_impact(spark):
    df = snapshot_rows(spark, [("g", "t", 0, c, e, None, m) for m, c, e in [(0, 0, 10), (5, 8, 30), (9, 9, 50)]])
    lags = lag.lag_by_partition(df)
    assert lag.reset_impact(lags).first().skipped_offsets == 41
    targets = spark.createDataFrame([("g", at(6))], "group_id string, target_at timestamp")
    assert lag.reset_impact(lags, targets).first().skipped_offsets == 21


def test_reset_impact_shuffles_no_rows_by_group(spark, capsys):
    df = snapshot_rows(spark, [(g, t, p, 4, 9 + m, None, m) for g in "ab" for t in "xy" for p in range(3) for m in range(4)])
    lags = lag.lag_by_partition(df)
    targets = lags.groupBy("group_id").agg((F.max("snapshotted_at") - F.expr("interval 2 minutes")).alias("target_at"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lag.reset_impact(lags, targets)
        assert rows(out, "skipped_offsets") == [(6,)] * 12
        out.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_recent_history(spark):
    lags = lag.lag_by_partition(series(spark, [(0, 1), (10, 2), (30, 3), (31, 4)]))
    assert rows(lag.recent_lag_history(lags, 30), "lag") == [(2,), (3,), (4,)]
    assert rows(lag.recent_lag_history(lags, 1, "2024-01-01 00:31:00"), "lag") == [(4,)]


def test_partition_plan(spark):
    parts = spark.createDataFrame([("t", 5, 3)], "topic string, partition_count bigint, replication_factor int")
    keys = spark.createDataFrame([("t", k) for k in range(13)], "topic string, key int")
    cons = spark.createDataFrame([("t", 5)], "topic string, consumers int")
    r = lag.partition_increase_plan(parts, keys, cons).first()
    assert (r.new_partition_count, r.increase_advised, r.consumers_to_add) == (12, True, 0)


def test_properties_on_random_rows(spark):
    rnd = random.Random(11)
    data = [
        (f"g{g}", f"t{t}", p, rnd.randrange(5000), rnd.randrange(90_000), rnd.choice([None, 0, m]), m)
        for g, t, p, m in itertools.product(range(2), range(3), range(7), range(0, 40, 4))
    ]
    a = lag.analyze_topics(snapshot_rows(spark, data))
    rnd.shuffle(data)
    b = lag.analyze_topics(snapshot_rows(spark, data))
    cols = ["group_id", "topic", "snapshotted_at", "total_lag", "lag_velocity_per_min", "lag_classification", "severity_score"]
    first = rows(a, *cols)
    assert first == rows(b, *cols)
    assert len(first) == 2 * 3 * 10
    assert all(0 <= r[-1] <= 1 and r[-2] in C.CLASS_MULTIPLIER for r in first)


def test_simultaneous_and_acceleration(spark):
    pts = [("g1", "t1", v, m) for m, v in [(0, 10), (2, 40), (4, 100), (6, 120)]]
    pts += [("g2", "t2", v, m) for m, v in [(0, 10), (2, 40), (4, 100), (6, 90)]]
    df = snapshot_rows(spark, [(g, t, p, 0, v, None, m) for g, t, v, m in pts for p in range(2)])
    v = lag.with_velocity(lag.topic_lag(lag.lag_by_partition(df)))
    assert rows(lag.simultaneous_lag(v), "snapshotted_at", "rising_groups") == [(naive(m), 2) for m in (2, 4, 6)]
    trend = {
        (r.group_id, r.snapshotted_at): r.trend for r in lag.lag_acceleration(v).collect()
    }
    assert trend[("g1", naive(0))] == "UNKNOWN"
    assert trend[("g1", naive(4))] == "ACCELERATING"
    assert trend[("g1", naive(6))] == "DECELERATING"


def test_first_commit_of_a_group_is_a_change(spark):
    rows = [(f"2024-01-01 0{h}:00:00", "g", "t", 0, None if h < 2 else 5, 10) for h in range(6)]
    df = spark.createDataFrame(rows, "at string, group_id string, topic string, partition int, committed_offset long, log_end_offset long")
    got = lag.with_last_commit(df.withColumn("snapshotted_at", F.col("at").cast("timestamp")).drop("at")).orderBy("snapshotted_at").collect()
    assert [None if r.last_commit_at is None else r.last_commit_at.hour for r in got] == [None, None, 2, 2, 2, 2]
    assert "_offset" not in got[0].asDict()


def test_snapshots_cover_all_hours_of_the_events(spark):
    from lagscope.sources.derived import lag_snapshots

    rows = [(1, 1, "view", "2023-12-30 05:10:00", 0.5), (2, 1, "view", "2024-02-03 07:59:59", 0.5), (3, 2, "view", "2024-01-15 00:00:00", 0.5)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, at string, value double").withColumn("ts", F.col("at").cast("timestamp"))
    got = lag_snapshots(events)
    first, last = got.agg(F.min("snapshotted_at").cast("string"), F.max("snapshotted_at").cast("string")).first()
    assert (first, last) == ("2023-12-30 05:00:00", "2024-02-03 07:00:00")
    hours = 35 * 24 + 3
    assert got.count() == hours * 4 * 2
    end = got.filter("topic = 'view-0' and partition = 1 and group_id = 'g0'").agg(F.max("log_end_offset")).first()[0]
    assert end == 2 * 101


def some_events(spark, folder):
    events = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") * 37 % 800).alias("user_id"), F.lit("view").alias("event_type"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 977 % 180_000).alias("ts"), F.lit(0.5).alias("value"),
    )
    events.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_tasks_of_last_commit_follow_the_snapshots(spark, tmp_path, monkeypatch):
    from lagscope.plans.queries import REGISTRY
    from lagscope.sources import derived

    folder = some_events(spark, tmp_path)

    def run(name):
        out = REGISTRY[name](spark, folder)
        return sorted(map(str, out.collect())), out.select(F.spark_partition_id()).distinct().count()

    names = ["last_commit_at", "catch_up_minutes"]
    few = [run(n) for n in names]
    monkeypatch.setattr(derived, "SNAPSHOTS_PER_TASK", 500)
    for name, (rows_before, tasks_before) in zip(names, few, strict=True):
        rows_after, tasks_after = run(name)
        assert rows_after == rows_before and rows_after
        if name == "last_commit_at":
            assert tasks_before <= 4 < 12 < tasks_after


def test_a_topic_is_laid_out_in_one_task(spark, tmp_path):
    from lagscope.sources import derived

    events = spark.read.parquet(some_events(spark, tmp_path) + "/events.parquet")
    got = derived.lag_snapshots(events, tasks=7).select("topic", "partition", F.spark_partition_id().alias("task"))
    spread = got.groupBy("topic").agg(F.countDistinct("task").alias("tasks"), F.countDistinct("partition").alias("n")).collect()
    assert len(spread) == 13 and {r.n for r in spread} == {8} and {r.tasks for r in spread} == {1}


def test_lag_trend_is_a_least_squares_slope(spark):
    from lagscope.operators import lag as L

    rows = [("g", "t", f"2024-01-01 00:{m:02d}:00", 100 + 30 * m + (5 if m == 4 else 0)) for m in range(0, 10, 2)]
    rows += [("g", "u", "2024-01-01 00:00:00", 7)]
    topics = spark.createDataFrame(rows, "group_id string, topic string, snapshotted_at string, total_lag long").withColumn(
        "snapshotted_at", F.col("snapshotted_at").cast("timestamp")
    )
    got = {(r.topic, r.snapshotted_at.minute): r for r in L.lag_trend(topics, window_seconds=300).collect()}
    assert got[("u", 0)].lag_slope_per_min is None and got[("t", 0)].lag_slope_per_min is None
    assert got[("t", 2)].lag_slope_per_min == pytest.approx(30.0)
    # 00:00 is 6 minutes before 00:06, outside the 5-minute window: three samples, 2, 4 and 6.
    assert got[("t", 6)].trend_points == 3 and got[("t", 6)].lag_slope_per_min == pytest.approx(30.0)
    assert got[("t", 4)].slope_change == pytest.approx(got[("t", 4)].lag_slope_per_min - 30.0)
