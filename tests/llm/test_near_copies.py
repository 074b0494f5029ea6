import random
import re
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from lagscope.llm import near_copies
from lagscope.llm.near_copies import one_near_copy


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def stay(rows):
    """The doc_ids that stay, by comparing every pair."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(min((x for x in g if x is not None), default=-1) for g in groups.values())


def kept(spark, rows, call=one_near_copy):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in call(spark.createDataFrame(rows, "doc_id long, text string")).collect())


@pytest.fixture(scope="module")
def copies():
    """Families of copies with more and more words changed, on both sides of 0.8, one of them large."""
    rnd = random.Random(3)
    rows = []
    for family in range(30):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 60, 200, 500]))]
        for _ in range(120 if family == 0 else 6):
            words = list(base)
            for _ in range(rnd.randrange(1, max(3, len(words) // 30))):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark, texts):
    assert kept(spark, texts) == stay(texts)
    assert kept(spark, []) == []


@pytest.mark.parametrize(("band", "size"), [(512, 1 << 17), (5, 1 << 12)])
def test_copies_against_brute_force(spark, copies, monkeypatch, band, size):
    monkeypatch.setattr(near_copies, "BAND_TILE", band)
    monkeypatch.setattr(near_copies, "SIZE_TILE", size)
    assert kept(spark, copies) == stay(copies)


def test_the_pipeline_keeps_one_of_each_simhash_class(spark, copies):
    # The pipeline's near-copy stage is operator 8 with its contract's parameters, not this module.
    from lagscope.llm.simhash_dedup import simhash_classes

    docs = spark.createDataFrame(copies, "doc_id long, text string")
    classes = {r.doc_id: r.component_id for r in simhash_classes(docs).collect()}
    got = kept(spark, copies, lambda d: corpus_pipeline.drop_near_duplicates(spark, d, ""))
    assert sorted(classes[d] for d in got) == sorted(set(classes.values()))


def test_pairs_at_the_threshold_are_compared():
    rng = np.random.default_rng(7)
    pairs = 2000
    same, own = rng.integers(0, 1 << 63, (pairs, 80)).astype(np.uint64), rng.integers(0, 1 << 63, (2, pairs, 10)).astype(np.uint64)
    (_, a, x), (_, b, y) = (near_copies.sketches(np.concatenate((same, o), axis=1).reshape(-1), np.arange(0, pairs * 90 + 1, 90)) for o in own)
    assert (a == b).any(axis=1).all() and ((x == y).sum(axis=1) >= near_copies.LEAST_EQUAL).all()
    assert abs((x == y).mean() - 0.8) < 0.01
