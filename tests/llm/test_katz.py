import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lagscope.llm.katz import LARGEST, discounts, katz_scores


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))), None]


def held(doc):
    return None if doc is None else zlib.crc32(str(doc).encode()) % 7 == 2


class Plain:
    """The model by dictionaries."""

    def __init__(self, rows):
        train = [tokens(t) for d, t in rows if held(d) is False]
        self.c = Counter(w for t in train for w in t)
        self.pairs = Counter(p for t in train for p in zip([None, *t], t, strict=False))
        self.n = sum(self.c.values())
        of = lambda c: [sum(1 for v in c.values() if v == r) for r in range(1, LARGEST + 2)]
        self.d1, self.d2 = discounts(of(self.c)), discounts(of(self.pairs))
        used = sum(self.cut(self.d1, v) for v in self.c.values())
        self.free = self.n - used
        self.scale = self.n if self.free > 1e-9 else self.n + 1
        self.free = self.free if self.free > 1e-9 else 1.0
        self.after = defaultdict(dict)
        for (u, w), v in self.pairs.items():
            self.after[u][w] = v

    @staticmethod
    def cut(d, r):
        return d[min(r, LARGEST + 1)] * r

    def p1(self, w):
        return self.cut(self.d1, self.c[w]) / self.scale if self.c[w] else self.free / max(self.scale, 1)

    def p2(self, u, w):
        seen = self.after.get(u)
        if not seen:
            return self.p1(w)
        total = sum(seen.values())
        gone = total - sum(self.cut(self.d2, v) for v in seen.values())
        total, gone = (total, gone) if gone > 1e-9 else (total + 1, 1.0)
        return self.cut(self.d2, seen[w]) / total if w in seen else gone / total / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def row(self, doc, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + len(self.c) + 1)) for w in t)
        return doc, held(doc), len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.p2(u, w)) for u, w in zip([None, *t], t, strict=False))


def fixture(n=250, seed=3):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(3000)]
    return [(i, " ".join(rng.choice([w, w.upper(), w]) for w in rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 1500}, {"chunk_bytes": 1500, "hot": 30, "hot_shares": 10**9}])
def test_against_dictionaries(spark, options, monkeypatch):
    rows = fixture()
    if options:
        monkeypatch.setattr("lagscope.llm.katz.BUCKET_WORDS", 1000)
    plain = Plain(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "true as held_out")
    same(katz_scores(frame, **options).collect(), [plain.row(d, t) for d, t in rows])


def test_probabilities_add_up(spark):
    rows = fixture(120)
    plain = Plain(rows)
    for u in [*list(plain.after)[:40], b"never seen"]:
        assert sum(plain.p2(u, w) for w in [*plain.c, b"never seen"]) == pytest.approx(1.0)


def test_odd_rows(spark, texts):
    plain = Plain(texts)
    same(katz_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect(), [plain.row(d, t) for d, t in texts])


def test_without_training_rows(spark):
    got = katz_scores(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_empty(spark):
    assert katz_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_discounts():
    n = [1000, 300, 150, 90, 60, 44, 33, 26]
    d = discounts(n)
    assert ((d[1:-1] > 0) & (d[1:-1] < 1)).all() and d[-1] == 1
    gone = sum((1 - d[r]) * r * n[r - 1] for r in range(1, LARGEST + 1))
    assert gone == pytest.approx(n[0])  # Katz: as much as the once-seen have
    assert (discounts([0] * 8)[1:-1] < 1).all()
