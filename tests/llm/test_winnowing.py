import hashlib

import numpy as np

from lagscope.llm.queries import _hex
from lagscope.llm.winnowing import BASE, K, W, code_points, fingerprints, kgram_hashes, likeness, winnow

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_hashes(text):
    c = [ord(ch) for ch in text]
    k = min(K, len(c))
    out = []
    for i in range(len(c) - k + 1) if c else []:
        h = 0
        for x in c[i : i + k]:
            h = (h * BASE + x) & M
        out.append(mix(h))
    return out


def plain_winnow(h):
    if not h:
        return [], []
    w = min(W, len(h))
    picked = []
    for i in range(len(h) - w + 1):
        window = h[i : i + w]
        least = min(window)
        at = i + max(j for j, x in enumerate(window) if x == least)
        if not picked or picked[-1] != at:
            picked.append(at)
    return [h[a] for a in picked], picked


def plain_like(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_hashes_and_windows():
    for text in ["", "a", "short text", "x" * 100, "É été où ça \U0001f600 " * 20, "abcab" * 40]:
        h = plain_hashes(text)
        assert kgram_hashes(code_points(text)).tolist() == h
        got, at = winnow(np.array(h, np.uint64))
        assert (got.tolist(), at.tolist()) == plain_winnow(h)


def test_guarantee():
    rnd = np.random.default_rng(3)
    shared = "".join(chr(c) for c in rnd.integers(97, 123, K + W - 1))
    for _ in range(20):
        a = "".join(chr(c) for c in rnd.integers(97, 123, 300))
        b = "".join(chr(c) for c in rnd.integers(97, 123, 300))
        fa, _ = winnow(kgram_hashes(code_points(a[:100] + shared + a[100:])))
        fb, _ = winnow(kgram_hashes(code_points(b[:200] + shared + b[200:])))
        assert len(np.intersect1d(fa, fb)) > 0


def plain_rows(rows):
    """Sort, take each next row, fingerprint everything one by one."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (doc, text) in enumerate(ordered):
        t, nxt = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        f, e, n = (plain_winnow(plain_hashes(x))[0] for x in (t, edited, nxt))
        out.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:016x}" for h in f), "".join(f"{h:016x}" for h in e), plain_like(f, e), plain_like(f, n)))
    return sorted(out, key=str)


def test_against_plain(spark, texts):
    rows = texts + [(40, "z" * 10), (41, "Zz"), (39, "word " * 500), (39, "other " * 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tie", "2 AS row", "3 AS task", "'x' AS first", "'y' AS last")
    for tasks in (1, 3, 40):
        found = fingerprints(frame, tasks=tasks)
        got = found.select("doc_id", "n_chars", "edited_sha256", _hex("hashes"), _hex("edited_hashes"), "near_edited", "near_next").collect()
        assert sorted(map(tuple, got), key=str) == plain_rows(rows)


def test_one_row_and_empty(spark):
    text = "just one text that is long enough to hash"
    one = spark.createDataFrame([(5, text)], "doc_id long, text string")
    (row,) = fingerprints(one).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256((text[:28] + text[:13]).encode()).hexdigest()
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert likeness(np.zeros(0, np.uint64), np.zeros(0, np.uint64)) == 1.0
