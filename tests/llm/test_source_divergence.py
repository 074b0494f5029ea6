import random
import re
from collections import Counter

import duckdb
import pandas as pd

from lagscope.llm.oracle import SOURCE_DIVERGENCE
from lagscope.llm.source_divergence import source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows():
    rnd = random.Random(7)
    words = ["Alpha", "beta", "GAMMA", "délta", "été", "x", "Zed", "ünïcode", "b2b", "naïve", "ÉCOLE"]
    out = []
    for i in range(140):
        lang = ["en", "de", None][i % 3]
        source = [f"s{i % 4}", None, "hot", "hot", "hot"][i % 5]
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
        out.append((i, text if i % 17 else None, lang, source))
    out += [(900, "lonely words only here", "xx", "one"), (901, "", "yy", "a"), (902, None, "yy", "b"), (903, "Q" * 5000, "en", "s1")]
    out += [out[5], out[5]]
    return out


def plain(data):
    """Dense sums over every kept term, straight from the definition."""
    docs = [((lang or ""), (source or ""), [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in TERM.findall(text or "")]) for _, text, lang, source in data]
    out = []
    for lang in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= 30)
        v = len(kept)
        sources = sorted({d[1] for d in mine})
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in sources}
        whole = Counter(t for d in mine for t in d[2])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p = {s: share(counts[s]) for s in sources}
        q = share(whole)
        for s in sources:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, val, r + 1) for r, (val, o) in enumerate(pairs)]
            over = sorted(((p[s][t] - q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, val, r + 1) for r, (val, t) in enumerate(over[:50])]
    return sorted(out)


def test_against_plain_and_sql(spark):
    data = rows()
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "1 AS n", "2 AS cnt", "3 AS total", "4 AS vocab", "5 AS a", "6 AS p", "'t' AS term", "7 AS kind", "8 AS base", "'s' AS s"
    )
    for blocks in (1, 3):
        got = sorted(tuple(r) for r in source_divergence(frame, blocks=blocks).collect())
        assert got == plain(data)
    documents = pd.DataFrame(data, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    sql = sorted(tuple(r) for r in duckdb.sql(SOURCE_DIVERGENCE).fetchall())
    assert sql == got
    assert {r[0] for r in got if r[2] == "term"} == {"en", "de", ""}
    assert [r for r in got if r[0] == "yy"] == [("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert source_divergence(empty).count() == 0
