import hashlib
import random

import numpy as np
import pytest

from lagscope.llm.suffix_array import same_as_before, sort_suffixes, suffix_types
from lagscope.llm.suffix_dedup import LENGTH, deduplicated, repeated_passages, repeated_windows


def plain(rows):
    """Every window by hand. Rows of equal doc_id in an order that the caller knows."""
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    same = {}  # equal (doc_id, text) is one document
    marks = []
    for i in order:
        raw = (rows[i][1] or "").encode()
        name = same.setdefault((rows[i][0], raw), i)
        gone = bytearray(len(raw))
        for at in range(len(raw) - LENGTH + 1):
            w = raw[at : at + LENGTH]
            if first.setdefault(w, (name, at)) != (name, at):
                gone[at : at + LENGTH] = b"\x01" * LENGTH
        marks.append((i, raw, gone))
    out = []
    for i, raw, gone in marks:
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def fixture(seed=0, n=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ñ", k=rng.randint(1, 6))) for _ in range(60)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    common = text(40)
    whole = text(120)
    rows = []
    for i in range(n):
        kind = i % 6
        body = text(rng.randint(0, 80))
        if kind == 0:
            body = f"{body} {common} {text(10)}"
        elif kind == 1:
            body = whole
        elif kind == 2:
            changed = whole.split(" ")
            changed[rng.randrange(len(changed))] = "X"
            body = " ".join(changed)
        elif kind == 3:
            at = rng.randrange(150)
            body += whole[at : at + rng.randint(90, 140)] + text(5) + body
        elif kind == 4:
            body = rng.choice(["a" * 350, "ab" * 170, "xyz " * 60 + body, common * 2])
        rows.append((rng.randrange(10_000) * 1000 + i, body))
    rng.shuffle(rows)
    return rows


def report(frame, **options):
    return sorted((tuple(r) for r in repeated_passages(frame, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000}, {"chunk_bytes": 12_000, "hot": 8, "hot_shares": 10**9}])
def test_against_all_windows(spark, options):
    rows = fixture() if not options.get("hot") else [(i, f"{i * 7919 % 1000003:07d} " * 3 + r[1]) for i, r in enumerate(fixture(3, 120) + [(0, f"{k} {'shared passage of many documents, ' * 5} {k * k}") for k in range(60)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as docs", "3 as c0")
    got = report(frame, **options)
    assert got == plain(rows)
    assert any(r[2] for r in got)


def test_odd_rows(spark, texts):
    rows = [(d, t) for d, t in texts]
    assert report(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=500) == plain(rows)


def test_text_over_several_segments(spark):
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefghij ", k=2_300_000))
    rows = [(2, long), (1, long[1_048_000:1_049_500]), (3, long[2_097_000:2_097_300] + "end")]
    assert report(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_rows_of_the_pipeline(spark, texts):
    rows = [(d, t, "en", 5) for d, t in texts]
    frame = spark.createDataFrame(rows, "doc_id long, text string, c0 string, left long")
    out = deduplicated(frame)
    assert out.columns == frame.columns and out.schema == frame.schema
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (5, None) in got and (6, "") in got and (2, "") in got and (8, "one") in got


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(60):
        strings = ["".join(rng.choices("ab", k=rng.randint(1, 30))).encode() for _ in range(rng.randint(1, 6))]
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
        ends = np.concatenate([np.full(len(s) + 1, e) for s, e in zip(strings, np.cumsum([len(s) + 1 for s in strings]) - 1, strict=True)])
        suffix = lambda i: bytes(text[i : ends[i]].astype(np.uint8))  # noqa: E731, B023
        wanted = np.array([rng.random() < 0.6 for _ in text]) & (text > 0)
        order = sort_suffixes(text, ends, wanted, 40)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        assert [suffix(i) for i in order] == sorted(suffix(i) for i in np.flatnonzero(wanted))
        types = suffix_types(text)
        assert all(types[i] == (suffix(i) < suffix(i + 1)) for i in range(len(text) - 1) if text[i] > 0 and text[i + 1] > 0)
        ok = np.array([i for i in order if ends[i] - i >= 5], np.int64)
        assert same_as_before(text, ok, 5).tolist() == [k > 0 and suffix(ok[k])[:5] == suffix(ok[k - 1])[:5] for k in range(len(ok))]


def test_windows_of_lower_rank():
    base = bytes(range(1, 131))
    found = repeated_windows([base, base[:110] + b"zz", b"q" + base[10:125]], np.array([31, 13, 17]), np.array([2, 1, 3]))
    assert [f.tolist() for f in found] == [[True] * 11 + [False] * 20, [False] * 13, [False] + [True] * 16]
