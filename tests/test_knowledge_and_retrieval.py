import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagscope.functions.columns import snapshot_id, stable_id
from lagscope.operators import ivf, knowledge, retrieval
from lagscope.sources import readers

from helpers import rows

DOC = "# Title here\n\nIntro text\n### First part\nbody one\n### Second part \nbody two GROWING_LAG"


def test_sections(spark):
    docs = spark.createDataFrame([("rb", DOC)], "runbook_id string, content string")
    got = knowledge.runbook_chunks(docs).orderBy("section_no").collect()
    assert [r.section for r in got] == ["overview", "First part", "Second part"]
    assert got[0].title == "Title here\n\nIntro text"
    assert got[1].content == "Title here\n\nIntro text\n### First part\nbody one"
    assert got[0].content == "# Title here\n\nIntro text"
    assert got[1].id == int(hashlib.md5(b"rb_1").hexdigest()[:15], 16)
    assert all(r.lag_classifications == ["GROWING_LAG"] for r in got)
    first = knowledge.section_chunks(docs, title="first_line").first()
    assert first.title == "Title here"


def test_sections_are_whole_and_have_a_prefix(spark):
    docs = spark.createDataFrame([("rb", "x" * 2000 + "\n### s\n" + "y" * 10)], "runbook_id string, content string")
    got = knowledge.section_chunks(docs).orderBy("section_no").collect()
    assert [len(r.content_prefix) for r in got] == [1200, 1200] and len(got[1].title) == 2000
    assert got[0].content == "x" * 2000 and got[1].content == "x" * 2000 + "\n### s\n" + "y" * 10


def test_tags(spark):
    docs = spark.createDataFrame(
        [("a", "a Thundering Herd came"), ("b", "STALLED_CONSUMER, growing lag"), ("c", "nothing")],
        "runbook_id string, content string",
    )
    got = {r.runbook_id: r.lag_classifications for r in knowledge.keyword_tags(docs).collect()}
    assert got == {"a": ["THUNDERING_HERD"], "b": ["GROWING_LAG", "STALLED_CONSUMER"], "c": ["GROWING_LAG"]}


def test_ids(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("x",)], "t string")
    for r in df.select("t", stable_id(F.col("t")).alias("s"), snapshot_id(F.col("t")).alias("n")).collect():
        h = hashlib.md5(r.t.encode()).hexdigest()
        assert r.s == int(h[:15], 16) % 2**62 and r.n == int(h[:16], 16) % 2**63


def test_incident_files_and_chunks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"incident_id": "I1", "symptoms_description": " ", "resolution_type": "X", "resolution_notes": "n",
         "cluster_state_at_onset": {"brokers": 3}},
        {"incident_id": "I2", "symptoms_description": "slow"},
    ]))
    (tmp_path / "b.json").write_text(json.dumps({"incident_id": "I3"}))
    got = knowledge.incident_chunks(readers.incidents(spark, str(tmp_path)))
    assert rows(got, "incident_id", "chunk_type") == [
        ("I1", "cluster_state"), ("I1", "resolution"), ("I2", "cluster_state"), ("I2", "resolution"),
        ("I2", "symptoms"), ("I3", "cluster_state"), ("I3", "resolution"),
    ]
    texts = {(r.incident_id, r.chunk_type): r.content for r in got.collect()}
    assert texts[("I1", "resolution")] == "Resolution: X. n"
    assert texts[("I3", "cluster_state")] == "Cluster state: {}"


def test_runbook_files(spark, tmp_path):
    (tmp_path / "one.md").write_text(DOC)
    r = readers.runbooks(spark, str(tmp_path)).first()
    assert r.runbook_id == "one" and r.content == DOC


def vectors(spark, n, dim=8, seed=5, copies=0):
    rnd = np.random.RandomState(seed)
    x = rnd.normal(size=(n, dim)).astype("float32")
    data = [(i, [float(v) for v in x[i]]) for i in range(n)]
    data += [(n + i, data[0][1]) for i in range(copies)]
    return spark.createDataFrame(data, "id bigint, embedding array<float>"), {i: np.array(v) for i, v in data}


def brute(queries, corpus, k, threshold, ok=lambda q, c: True):
    out = {}
    for q, qv in queries.items():
        scored = []
        for c, cv in corpus.items():
            s = float(qv @ cv / np.linalg.norm(qv) / np.linalg.norm(cv))
            if s >= threshold and ok(q, c):
                scored.append((-round(s, 9), c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "position").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("probes", [1, 64])
def test_search_is_exact_in_both_ways(spark, probes):
    # A third of the corpus are copies of one vector: the limit must hold and ids decide.
    c, cv = vectors(spark, 120, copies=60)
    q, qv = vectors(spark, 15, seed=9)
    q = q.withColumnRenamed("id", "query_id").unionByName(
        c.filter("id = 0").select(F.lit(99).cast("bigint").alias("query_id"), "embedding")
    )
    qv = {**qv, 99: cv[0]}
    got = ivf.vector_topk_ivf(q, c.repartition(5), 7, 0.3, probes=probes).drop("part")
    assert found(got) == found(retrieval.vector_topk(q, c.repartition(5), 7, 0.3))
    expected = {k: v for k, v in brute(qv, cv, 7, 0.3).items() if v}
    assert found(got) == expected
    assert found(got)[99] == [0, 120, 121, 122, 123, 124, 125]


def test_search_edges(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0])], "id bigint, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "query_id bigint, embedding array<float>")
    assert found(retrieval.vector_topk(q, c, 5, 0.5)) == {1: [2]}
    assert retrieval.vector_topk(q.filter("query_id = 0"), c, 5, 0.5).count() == 0


def test_incidents_are_deduplicated_after_the_limit(spark):
    # Twenty-one chunks: the 20 nearest are all of incident A, so B is never seen.
    data = [(i, "A", [1.0, 0.001 * i]) for i in range(20)] + [(20, "B", [1.0, 0.5])]
    c = spark.createDataFrame(data, "id bigint, incident_id string, embedding array<float>")
    for col in ("lag_classification", "consumer_group", "topic", "resolution_type", "summary"):
        c = c.withColumn(col, F.lit(None).cast("string"))
    c = c.withColumn("time_to_resolution_minutes", F.lit(None).cast("int"))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = retrieval.similar_incidents(q, c).collect()
    assert [(r.incident_id, r.lag_classification, r.time_to_resolution_minutes) for r in got] == [("A", "UNKNOWN", 0)]
    wide = retrieval.similar_incidents(q, c, overfetch=5).collect()
    assert [r.incident_id for r in wide] == ["A", "B"]


def test_runbook_filter_and_threshold(spark):
    data = [
        (1, ["GROWING_LAG"], [1.0, 0.0]), (2, ["THUNDERING_HERD"], [1.0, 0.0]),
        (3, ["GROWING_LAG", "THUNDERING_HERD"], [1.0, 2.4]), (4, ["GROWING_LAG"], [1.0, 2.2]),
    ]
    c = spark.createDataFrame(data, "id bigint, lag_classifications array<string>, embedding array<float>")
    for col in ("runbook_id", "title", "section", "content"):
        c = c.withColumn(col, F.col("id").cast("string"))
    q = spark.createDataFrame([("q", "GROWING_LAG", [1.0, 0.0])], "query_id string, lag_classification string, embedding array<float>")
    assert rows(retrieval.runbook_search(q, c), "position", "runbook_id") == [(1, "1"), (2, "4")]


def test_hashed_search_finds_near_vectors(spark):
    rnd = random.Random(2)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    data = [(i, [x + rnd.gauss(0, 0.05) for x in base[i % 10]]) for i in range(200)]
    c = spark.createDataFrame(data, "id bigint, embedding array<float>")
    q = spark.createDataFrame([(i, b) for i, b in enumerate(base)], "query_id bigint, embedding array<float>")
    exact, near = found(retrieval.vector_topk(q, c, 10, 0.8)), found(retrieval.vector_topk_lsh(q, c, 10, 0.8))
    hits = sum(len(set(exact[k]) & set(near.get(k, []))) for k in exact)
    assert hits >= 0.9 * sum(len(v) for v in exact.values())
    buckets = [retrieval.sign_buckets(f, key) for f, key in ((q, "query_id"), (c, "id"))]
    pairs = buckets[0].join(buckets[1], ["dims", "table_no", "bucket"]).select("query_id", "id").distinct().count()
    assert pairs < 0.2 * q.count() * c.count()


def test_vectors_of_several_lengths(spark):
    queries = spark.createDataFrame([("q2", [1.0, 0.0]), ("q3", [0.0, 1.0, 0.0]), ("q5", [1.0] * 5)], "query_id string, embedding array<double>")
    corpus = spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.0, 3.0, 0.1]), (3, [0.1, 0.2, 9.0])], "id long, embedding array<double>")
    got = retrieval.vector_topk(queries, corpus, 3, 0.5)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [("q2", 1), ("q3", 2)]


def test_many_queries_and_cells(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(40, 128)), rng.normal(size=(90, 128))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "id long, embedding array<double>")
    got = found(retrieval.vector_topk(queries, corpus, 4, -1.0))
    cosine = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    for i in range(40):
        assert set(got[i]) == set(np.argsort(-cosine[i])[:4])


def test_chunk_without_incident_stands_for_itself(spark):
    payload = "incident_id string, lag_classification string, consumer_group string, topic string, resolution_type string, time_to_resolution_minutes int, summary string"
    rows = [(7, [1.0, 0.0], None, None, None, None, None, None, None), (8, [1.0, 0.1], None, None, None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, f"id long, embedding array<double>, {payload}")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = retrieval.similar_incidents(queries, chunks).collect()
    assert [(r.position, r.incident_id) for r in got] == [(1, "7"), (2, "8")]


def test_mean_vectors_of_any_length(spark):
    from lagscope.sources.derived import class_query_vectors

    rows = [(0, 0, [1.0] * 130), (1, 0, [3.0] * 130), (2, 0, [5.0])]
    (got,) = class_query_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")).collect()
    assert got.embedding == [3.0] + [2.0] * 129
