import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagscope.functions.timeline import numbered, previous, running_sum
from lagscope.operators import dedup, lag, metrics
from lagscope.streaming import jobs

from helpers import T0, at, naive, rows, snapshot_rows


def greedy(times, ttl):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= ttl:
            out.append(t)
            last = t
    return out


def minutes(df, key="k"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(round((r.ts - T0.replace(tzinfo=None)).total_seconds() / 60, 3))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("slice_seconds", [600, 900, 3600, None])
def test_dedup_reference_sequence(spark, slice_seconds):
    df = spark.createDataFrame([("a", at(m), m) for m in [0, 5, 11, 25, 26, 40]], "k string, ts timestamp, n int")
    out = dedup.ttl_dedup(df, ["k"], "ts", 600, slice_seconds)
    assert minutes(out) == {"a": [0, 11, 25, 40]}
    assert rows(out, "n") == [(0,), (11,), (25,), (40,)]


def test_dedup_boundary_and_copies(spark):
    df = spark.createDataFrame([("a", at(m), "x") for m in [0, 0, 9.99, 10, 20]], "k string, ts timestamp, p string")
    assert minutes(dedup.ttl_dedup(df, ["k"], "ts", 600)) == {"a": [0, 10, 20]}


@pytest.mark.parametrize("slice_minutes", [10, 17, 60])
def test_dedup_against_a_plain_loop(spark, slice_minutes):
    rnd = random.Random(slice_minutes)
    # One hot key with a third of all hits, closely spaced; the others are sparse.
    data = {"hot": [rnd.uniform(0, 600) for _ in range(400)]}
    data |= {f"k{i}": [rnd.uniform(0, 600) for _ in range(16)] for i in range(50)}
    data = {k: [round(t, 3) for t in v] for k, v in data.items()}
    df = spark.createDataFrame([(k, at(t)) for k, v in data.items() for t in v], "k string, ts timestamp")
    out = dedup.ttl_dedup(df, ["k"], "ts", 600, slice_minutes * 60)
    assert minutes(out) == {k: greedy(v, 10) for k, v in data.items()}


def test_helpers_match_plain_windows(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("abc"), at(m), rnd.randrange(9)) for m in rnd.sample(range(3000), 300)]
    df = spark.createDataFrame(data, "k string, ts timestamp, v int")
    ordered = sorted(data, key=lambda r: (r[0], r[1]))
    for seconds in (3600, 86_400 * 10):
        got = previous(df, ["k"], "ts", ["v"], seconds).orderBy("k", "ts").collect()
        want = [
            ordered[i - 1][2] if i and ordered[i - 1][0] == r[0] else None for i, r in enumerate(ordered)
        ]
        assert [r.prev_v for r in got] == want
        sums, total = [], {}
        for k, _, v in ordered:
            total[k] = total.get(k, 0) + v
            sums.append(total[k])
        got = running_sum(df, ["k"], "ts", "v", "s", seconds).orderBy("k", "ts").collect()
        assert [r.s for r in got] == sums
    got = numbered(df, ["k"], ["v"], ["ts"], "n").orderBy("k", "v", "ts").collect()
    want = {}
    for r in got:
        want[r.k] = want.get(r.k, 0) + 1
        assert r.n == want[r.k]


# ---------------------------------------------------------------- streams


def stream_of(spark, tmp_path, df, batches):
    """A stream that reads the given row groups one after the other."""
    source = str(tmp_path / "source")
    for n, condition in enumerate(batches):
        df.filter(condition).coalesce(1).write.parquet(f"{source}/n={n:03d}")
    return (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(source)
    )


def run(spark, tmp_path, stream, name="out"):
    q = (
        jobs.start_table(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)), q


def test_stream_dedup_equals_batch(spark, tmp_path):
    hits = [("a", m) for m in [0, 5, 11, 25, 26, 40]] + [("b", m) for m in [3, 12, 13, 14]]
    df = spark.createDataFrame([(k, at(m), m) for k, m in hits] + [("~", at(9999), 9999)], "k string, ts timestamp, m int")
    # Minute 11 comes after minute 12 and 13, within the delay.
    order = ["m in (0, 3, 5)", "m in (12, 13, 14)", "m = 11", "m in (25, 26)", "m = 40", "m = 9999"]
    stream = stream_of(spark, tmp_path, df, order)
    out, _ = run(spark, tmp_path, jobs.ttl_dedup(stream, ["k"], "ts", 600, "5 minutes"))
    got = minutes(out.filter("k <> '~'"))
    assert got == minutes(dedup.ttl_dedup(df.filter("k <> '~'"), ["k"], "ts", 600))
    assert got == {"a": [0, 11, 25, 40], "b": [3, 13]}


def test_stream_velocity_and_class_equal_batch(spark, tmp_path):
    rnd = random.Random(8)
    data = [("g", t, p, 0, rnd.randrange(90_000), None, m) for t in ("t1", "t2") for p in range(3) for m in range(0, 60, 2)]
    # The last row moves the watermark of the first stream, the one before it that of the second.
    df = snapshot_rows(spark, data + [("~", "~", 0, 0, 0, None, m) for m in (99_999, 199_999)])
    minute = "(unix_seconds(snapshotted_at) - unix_seconds(timestamp'2024-01-01')) / 60"
    order = [f"{minute} between 0 and 21", f"{minute} between 30 and 33", f"{minute} between 22 and 29", f"{minute} between 34 and 60", f"{minute} > 60"]
    totals, _ = run(spark, tmp_path, jobs.lag_totals(stream_of(spark, tmp_path, df, order), "15 minutes"), "totals")
    again = spark.readStream.schema(totals.schema).parquet(str(tmp_path / "totals"))
    out, _ = run(spark, tmp_path, jobs.analyze_topics(again, "15 minutes"))
    cols = ["topic", "snapshotted_at", "total_lag", "lag_velocity_per_min", "lag_classification", "severity_score"]
    batch = lag.analyze_topics(df.filter("group_id <> '~'"))
    got = rows(out.filter("group_id <> '~'"), *cols)
    want = rows(batch, *cols)
    assert len(got) == 60
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3]) and a[5] == pytest.approx(b[5])


def test_stream_alerts_equal_batch(spark, tmp_path):
    values = list(enumerate([5, 20, 20, 20, 20, 5, 20, 20, 20, 5, 20]))
    df = spark.createDataFrame([("x", at(m), v) for m, v in values] + [("~", at(9999), 0)], "k string, ts timestamp, value bigint")
    firing = F.col("value") > 10
    order = ["ts < '2024-01-01 00:04:00'", "ts >= '2024-01-01 00:04:00' and ts < '2024-01-02'", "ts >= '2024-01-02'"]
    out, _ = run(spark, tmp_path, jobs.alert_states(stream_of(spark, tmp_path, df, order), firing, 180, ["k"]))
    cols = ["k", "ts", "value", "state"]
    want = metrics.alert_states(df.filter("k <> '~'"), firing, 180, ["k"])
    assert rows(out.filter("k <> '~'"), *cols) == rows(want, *cols)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    # A batch drops what is older than the watermark of the batch before.
    arrival = [0, 1, 30, 40, 2, 59]
    df = spark.createDataFrame([("t", at(m)) for m in arrival], "topic string, timestamp timestamp")
    order = [f"timestamp = timestamp'2024-01-01 00:{m:02d}:00'" for m in arrival]
    out, q = run(spark, tmp_path, jobs.messages_per_window(stream_of(spark, tmp_path, df, order), delay="5 minutes"))
    assert rows(out, "window_start") == [(naive(m),) for m in (0, 1, 30, 40)]
    assert jobs.late_rows(q) == 1


def test_config_changes_wait_for_whole_snapshots(spark, tmp_path):
    from lagscope import schemas

    def add(n, data):
        df = spark.createDataFrame([(at(m), b, t, p, 1) for m, b, t, p in data], schemas.CONFIG_SNAPSHOT)
        df.coalesce(1).write.parquet(str(tmp_path / f"source/n={n}"))

    def go():
        stream = (
            spark.readStream.schema(schemas.CONFIG_SNAPSHOT).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "source"))
        )
        jobs.start_config_changes(
            stream, *(str(tmp_path / n) for n in ("stored", "changes", "check")), "10 minutes", str(tmp_path / "brokers")
        ).trigger(availableNow=True).start().awaitTermination()

    def found():
        return rows(spark.read.parquet(str(tmp_path / "changes")), "snapshot_at", "topic", "change")

    add(0, [(0, 3, "a", 1)])
    add(1, [(0, 3, "b", 1)])  # the same snapshot in another file
    go()
    add(2, [(60, 4, "a", 2)])
    go()  # a restart, in the middle of a snapshot
    assert found() == []
    add(3, [(30, 3, "a", 1), (30, 3, "b", 1)])  # out of order, but 30 minutes late: closed without it
    add(4, [(60, 4, "c", 1)])
    add(5, [(55, 3, "a", 1), (55, 3, "b", 1)])  # out of order within the delay
    add(6, [(120, 4, "a", 2), (120, 4, "c", 1)])
    add(7, [(180, 4, "a", 2)])
    go()
    got = found()
    assert [(t, c) for at_, t, c in got if at_ == naive(60)] == [("a", "CHANGED"), ("b", "REMOVED"), ("c", "NEW")]
    assert [g for g in got if g[0] in (naive(0), naive(55), naive(120), naive(180))] == []
    assert rows(spark.read.parquet(str(tmp_path / "brokers")), "snapshot_at", "brokers_before", "brokers_after") == [(naive(60), 3, 4)]


def test_analysis_sinks_store_each_event_once(spark, tmp_path):
    schema = T.StructType.fromDDL(
        "analysis_id string, part int, analyzed_at timestamp, severity string,"
        " recommendations array<struct<recommendation_type:string,priority:string>>"
    )

    def add(n, data):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"source/n={n}"))

    add(0, [("e1", 0, at(0), "LOW", []), ("e2", 0, at(1), "HIGH", [("X", "P"), ("Y", "P")])])
    paths = {n: str(tmp_path / n) for n in ("analyses", "recommendations", "audit", "routes", "check")}

    def go():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "source"))
        jobs.start_analysis_sinks(
            stream, paths["analyses"], paths["recommendations"], paths["audit"], paths["routes"], paths["check"]
        ).trigger(availableNow=True).start().awaitTermination()

    go()
    add(1, [("e2", 0, at(1), "HIGH", [("X", "P")]), ("e2", 1, at(1), "HIGH", []), ("e3", 0, at(2), "LOW", [])])
    go()
    assert rows(spark.read.parquet(paths["analyses"]), "analysis_id", "part") == [("e1", 0), ("e2", 0), ("e2", 1), ("e3", 0)]
    assert rows(spark.read.parquet(paths["recommendations"]), "analysis_id", "recommendation_type") == [("e2", "X"), ("e2", "Y")]
    routes = rows(spark.read.parquet(paths["routes"]), "key", "topic")
    assert [k for k, t in routes if t.endswith("recommended")] == ["e2"] and len(routes) == 5
    assert spark.read.parquet(paths["audit"]).count() == 4


def test_analysis_sinks_take_the_events_of_the_engine(spark, small, tmp_path):
    from lagscope.operators import recommend
    from lagscope.plans.queries import Inputs

    events = Inputs(spark, small).events()
    source = str(tmp_path / "source")
    events.unionByName(events.limit(5)).write.parquet(source)  # some twice in the first batch
    paths = [str(tmp_path / n) for n in ("analyses", "recommendations", "audit", "routes", "check")]
    stream = spark.readStream.schema(events.schema).parquet(source)
    jobs.start_analysis_sinks(stream, *paths).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(source).dropDuplicates(["analysis_id", "part"])
    written, recommendations, audit = (spark.read.parquet(p) for p in paths[:3])
    assert written.count() == stored.count() > 0
    want = recommend.recommendation_rows(stored)
    columns = want.drop("cli_commands").columns
    assert recommendations.select(*columns).exceptAll(want.select(*columns)).count() == 0
    assert recommendations.count() == want.count() > 0
    assert audit.count() == stored.select("analysis_id").distinct().count()
    assert written.filter(F.size("similar_incident_ids") != F.size("similar_incidents")).count() == 0
