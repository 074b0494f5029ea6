import random

import numpy as np
import pytest

from lagscope.llm.quality_classifier import CoTrained, good, quality_scores

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choices(words, k=rng.randint(20, 80))) + "."
        bad = i % 4 == 0
        if bad:
            text = [text.upper().replace(" ", "!! "), " ".join([rng.choice(words)] * 50), text.replace(" ", "*** "), text.replace(" ", " | ")][i // 4 % 4]
        docs.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(not bad), 0))
    return docs, labels


def test_accuracy_on_unlabelled(spark):
    docs, labels = corpus()
    rows = quality_scores(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {d for d, _, _ in labels}
    assert len(rows) == len(docs)
    assert np.mean([r.kept == (r.doc_id % 4 != 0) for r in rows if r.doc_id not in known]) > 0.97


def test_rounds_exchange_labels():
    """The metadata view has too few labels to learn from and is taught by the other."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    a = y[:, None] * 2.0 + rng.normal(0, 0.5, (2000, 1))
    b = np.column_stack([y + rng.normal(0, 0.5, 2000), rng.normal(0, 1, (2000, 8))])
    few, rest = slice(0, 45), slice(45, 1500)
    before = CoTrained([a[few], b[few]], y[few], [a[rest], b[rest]], rounds=0).models[1]
    after = CoTrained([a[few], b[few]], y[few], [a[rest], b[rest]]).models[1]
    right = lambda m: np.mean((m.chance(b[1500:]) >= 0.5) == y[1500:])
    assert right(after) > right(before)


@pytest.mark.parametrize("marks,kept", [([], True), ([(1, 1, 0)], True), ([(1, 0, 0), (2, None, 0), (None, 1, 0)], False)])
def test_odd_rows_and_missing_classes(spark, texts, marks, kept):
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in texts], SCHEMA).selectExpr("*", "1 as quality_score", "2 as _quality_score", "3 as label")
    left = good(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert left.columns == docs.columns and left.count() == (len(texts) if kept else 0)


def test_odd_rows_with_a_model(spark, texts):
    docs, labels = corpus(200)
    odd = [(None if d is None else d + 1000, t, None, "s", None) for d, t in texts]
    rows = quality_scores(spark.createDataFrame(docs + odd, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in rows)


def test_empty(spark):
    assert quality_scores(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
