import random

import numpy as np
import pytest

from lagscope.llm.toxicity import Distances, build_dictionaries, toxicity, wide


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    parts = ["an", "ber", "co", "der", "el", "fi", "gol", "hun", "is", "ter", "mon", "ra"]
    common = ["".join(rng.choices(parts, k=2)) for _ in range(80)]
    bad = ["vilexq", "nastyx", "gromph", "zlark"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.7 else "".join(rng.choices(parts, k=3)) for _ in range(rng.randint(20, 80))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    rows = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r.predicted, labels[r.doc_id][2]) for r in rows if r.held_out]
    assert len(rows) == len(docs) and len(held) > 100
    assert np.mean([a == b for a, b in held]) > 0.97


def test_nulls_and_repeated_rows(spark, texts):
    docs, labels = corpus(300)
    frame = spark.createDataFrame(docs + [(None if d is None else d + 10_000, t) for d, t in texts], "doc_id long, text string").selectExpr("*", "1 as score", "2 as toxic")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None), (10_001, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity(frame, marks).collect()
    assert len(rows) == len(docs) + len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all((r.held_out is None) == (r.doc_id is None) for r in rows)


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1)]])
def test_without_both_classes(spark, texts, marks):
    rows = toxicity(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(texts) and len({r.score for r in rows}) == 1


def test_empty(spark):
    assert toxicity(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_distance_favours_words_of_its_dictionary():
    toxic, ordinary = build_dictionaries(["a b vile c", "d vile e", "f vile", "g vile h", "i vile", "j vile", "k vile", "l vile", "m vile"], ["good word", "fine word", "nice word", "one good", "two good"])
    assert wide(b" vile ") in toxic and wide(b" good ") in ordinary
    model = Distances(toxic, ordinary)
    assert model.window(b"vile") > 0 > model.window(b"good")
