import re
from itertools import permutations

from lagscope.llm.filter_audit import LETTERS, ORDERS, filter_audit, lehmer_rank, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, labels):
    """Every order applied to every row, one by one."""
    good, toxic = {}, {}
    for doc, quality, tox in labels:
        good[doc] = good.get(doc, 0) or int(quality == 1)
        toxic[doc] = toxic.get(doc, 0) or int(tox == 1)
    rows = []
    for doc, text, lang in docs:
        t = text or ""
        ws = WORD.findall(t)
        fail = {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": doc is not None and any(d is not None and d < doc and (x or "") == t for d, x, _ in docs),
        }
        rows.append((lang or "", fail, good.get(doc, 0) if doc is not None else 0, toxic.get(doc, 0) if doc is not None else 0))
    out = []
    for part in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == part]
        gone = {o: [next((i for i, x in enumerate(o) if f[x]), None) for _, f, _, _ in mine] for o in ORDERS}
        for o in ORDERS:
            for s, x in enumerate(o):
                removed = [r for r, g in zip(mine, gone[o]) if g == s]
                out.append((
                    part, o, s + 1,
                    sum(g is None or g > s for g in gone[o]),
                    len(removed),
                    sum(g is not None and g < s and r[1][x] for r, g in zip(mine, gone[o])),
                    sum(r[1][x] and sum(r[1].values()) == 1 for r in mine),
                    sum(r[2] for r in removed),
                    sum(r[3] for r in removed),
                    sum(sum(g is not None and p[g] == x for g in gone[p]) for p in ORDERS),
                ))
    return sorted(out)


def test_ranks_and_runs():
    assert [lehmer_rank(o) for o in ORDERS] == list(range(120))
    for mask in range(1, 32):
        cover = [0] * 120
        for letter, a, b in runs(mask):
            for r in range(a, b):
                first = next(x for x in ORDERS[r] if mask >> LETTERS.index(x) & 1)
                assert first == LETTERS[letter]
                cover[r] += 1
        assert cover == [1] * 120


def test_against_plain(spark, texts):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(d, t, lang) for (d, t), lang in zip(texts, ["en", "de", None, "en", "en", "de", "", "en", "en", "de", "en", "en", "de", "en", "en"])]
    docs += [(20, long, "en"), (21, long, "en"), (19, long, "de"), (21, long, "en"), (22, long.upper(), "en"), (23, long + " #", "de"), (None, long, "en")]
    labels = [(1, 1, 0), (20, 1, 1), (20, 0, 0), (21, 1, 0), (23, 0, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS t", "2 AS words", "3 AS key", "'x' AS part")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "0 AS good", "'y' AS first")
    got = sorted(tuple(r) for r in filter_audit(frame, lab).collect())
    assert got == plain(docs, labels)
    assert len(got) == 3 * 600


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs, labels).count() == 0
    assert sorted(permutations(LETTERS)) == [tuple(o) for o in ORDERS]
