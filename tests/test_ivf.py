import numpy as np
import pytest

from lagscope.operators import ivf, retrieval
from lagscope.sources import derived as D


def pairs(df):
    return sorted((r.query_id, r.id, r.position, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_inputs_exact_and_recall(spark, sf):
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q, c = D.query_vectors(emb), D.incident_vectors(emb)
    exact = pairs(retrieval.vector_topk(q, c, 20, 0.1))
    centres = ivf.fit_cells(c)
    index = ivf.assign(c, centres).cache()
    assert pairs(ivf.vector_topk_ivf(q, c, 20, 0.1, index=index, centres=centres)) == exact
    # Probing every cell in the first round alone is the exact search too.
    everything = ivf.vector_topk_ivf(q, c, 20, 0.1, index=index, centres=centres, probes=len(centres[64]), exact=False)
    assert pairs(everything) == exact
    first = {(r.query_id, r.id) for r in ivf.vector_topk_ivf(q, c, 20, 0.1, index=index, centres=centres, exact=False).collect()}
    recall = len(first & {(a, b) for a, b, _, _ in exact}) / len(exact)
    assert 0 < recall < 1  # the first round alone misses rows on these inputs; the second finds them


def test_hot_vector_nulls_and_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(200)]  # one vector, two fifths of the corpus
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, 2.0, 2.9])]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame(
        [("a", [1.0] * 8), ("b", rng.normal(size=8).tolist()), ("c", [1.0, 2.0, 3.0]), ("d", None), ("e", [0.0] * 8)], "query_id string, embedding array<double>"
    )
    for k, threshold in ((5, 0.1), (50, -1.0)):
        expected = pairs(retrieval.vector_topk(queries, corpus, k, threshold))
        assert pairs(ivf.vector_topk_ivf(queries, corpus, k, threshold)) == expected
    assert pairs(ivf.vector_topk_ivf(queries, corpus.limit(0), 5, 0.1)) == []


def test_small_sample_still_indexes_every_row(spark):
    rng = np.random.default_rng(2)
    corpus = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "id long, embedding array<double>")
    centres = ivf.fit_cells(corpus, cells=6, sample_rows=50)
    assert centres[4].shape == (6, 4)
    assert ivf.assign(corpus, centres).count() == 400
