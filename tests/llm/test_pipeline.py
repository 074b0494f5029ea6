import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lagscope.llm.decontamination import contaminated
from lagscope.llm.quality_classifier import quality_scores


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], small).cache())
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_dedup", "suffix_dedup", "decontamination", "sentencepiece"]
    for out in stages[1:-1]:
        assert out.columns == stages[0].columns and out.schema.simpleString() == stages[0].schema.simpleString()


def test_decisions_take_effect(spark, small, stages):
    docs, rated, single, cut, clear, coded = stages
    scores = quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet"))
    ids = lambda f: {r.doc_id for r in f.select("doc_id").collect()}
    assert ids(rated) == ids(scores.where("kept"))
    assert ids(single) < ids(rated) and single.count() == single.select("doc_id").distinct().count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts.keys() == ids(single)
    assert cut.where(F.length("text") != F.col("n_chars")).count() == 0
    leaked = ids(contaminated(cut, spark.read.parquet(f"{small}/benchmark.parquet")))
    assert ids(clear) == ids(cut) - leaked
    rows = coded.collect()
    assert {r.doc_id for r in rows} == ids(clear) and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)


def test_run_is_all_stages(spark, small, stages):
    got = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == {(r.doc_id, tuple(r.ids)) for r in stages[-1].collect()}


def test_near_copies_are_operator_8s_classes(spark, stages):
    from lagscope.llm.simhash_dedup import simhash_classes

    rated, single = stages[1], stages[2]
    classes = {r.doc_id: r.component_id for r in simhash_classes(rated).collect()}
    kept = [r.doc_id for r in single.select("doc_id").collect()]
    assert sorted(classes[d] for d in kept) == sorted(set(classes.values()))
