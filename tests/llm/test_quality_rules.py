import re
from collections import Counter

from lagscope.llm.quality_rules import DUPLICATED, LINE_CHARS, LINES, SYMBOLS_PER_WORD, TOP, quality_rules


def plain(text):
    text = text or ""
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    chars = sum(map(len, words))

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        c = Counter(grams)
        return {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(n)}, c

    lines = [x for x in text.split("\n") if re.search(rb"[^\x20\x09-\x0D]", x.encode())]
    length = lambda x: sum(len(w.decode()) for w in re.findall(rb"[^\x20\x09-\x0D]+", x.encode()))
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    repeat = len(covered(3)[0])
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    bad = symbols > SYMBOLS_PER_WORD * len(words) or len(dup) > LINES * len(lines)
    bad |= sum(map(length, dup)) > LINE_CHARS * max(sum(map(length, lines)), 1)
    for n, most in DUPLICATED.items():
        bad |= sum(len(words[i]) for i in covered(n)[0]) / max(chars, 1) > most
    for n, most in TOP.items():
        bad |= max((k * sum(map(len, g)) for g, k in covered(n)[1].items() if k > 1), default=0) / max(chars, 1) > most
    return len(words), chars, symbols, len(dup), repeat, failed, not failed and not bad


def test_against_plain_loops(spark, texts):
    texts = [*texts, (20, "# x | y & $5\n" * 3 + " ".join(f"q{i}" for i in range(60))), (21, "\n\n a\x0bb\x0cc \x1cd\n a\x0bb\x0cc \x1cd")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as kept")
    got = sorted((tuple(r)[:8] for r in quality_rules(docs).collect()), key=str)
    assert got == sorted(((d, *plain(t)) for d, t in texts), key=str)
    assert any(r[7] for r in got) and any(r[6] for r in got)


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
