import re
from itertools import combinations

import numpy as np
import xxhash

from lagscope.llm.simhash_dedup import PLACES, SEGMENTS, block_keys, distances, links, one_of_each, simhash_classes


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, f"{p:016x}", low[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def test_against_brute_force(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as print", "2 as component_id")
    assert sorted(map(tuple, simhash_classes(docs).collect()), key=str) == classes(texts)


def test_empty(spark):
    assert simhash_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_blocks_find_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = [base]
    for _ in range(2):
        flips = np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)
        near.append(near[-1] ^ flips)
    prints = np.unique(np.concatenate(near))
    keys = block_keys(distances(prints))
    want = {(int(a), int(b)) for a, b in combinations(prints, 2) if int(a ^ b).bit_count() <= 2}
    together = {k: set(map(int, row)) for k, row in zip(map(int, prints), keys, strict=True)}
    assert want and all(together[a] & together[b] for a, b in want)
    block = keys.reshape(-1).view(np.int64)
    order = np.argsort(block)
    a, b = links(block[order], np.repeat(prints, keys.shape[1])[order], held=10)
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    got, exact = {}, {}
    for x, y in zip(a, b, strict=True):
        parent[find(int(x))] = find(int(y))
    got = [find(int(p)) for p in prints]
    parent = {int(p): int(p) for p in prints}
    for x, y in want:
        parent[find(x)] = find(y)
    exact = [find(int(p)) for p in prints]
    assert len(set(zip(got, exact, strict=True))) == len(set(got)) == len(set(exact))


def test_a_block_is_bounded():
    assert max(a[1] + b[1] for a, b in combinations(SEGMENTS, 2)) == 12
    assert sum(w for _, w in SEGMENTS) == 64 and len(PLACES) == 11


def test_one_document_of_each_class_stays(spark, texts):
    docs = spark.createDataFrame([(d, t, "en") for d, t in texts], "doc_id long, text string, lang string").selectExpr("*", "1 as print", "2 as tie", "3 as id", "4 as _id")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    groups = {}
    for d, _, c in classes(texts):
        groups.setdefault(c, []).append(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(x for x in g if x is not None) for g in groups.values())
