import random
import re
from itertools import combinations

from lagscope.llm.decontamination import MASKS, SPAN, WINDOW, clean, contaminated, needed


def words(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def plain(docs, items):
    out = {}
    for d, text in docs:
        own = words(text)
        for i, item in items:
            theirs = words(item)
            if not theirs:
                continue
            n = min(WINDOW, len(theirs))
            least = needed(n) if len(theirs) >= SPAN else n
            best = 0
            for shift in range(-len(theirs), len(own)):
                same = [own[k + shift] == w if 0 <= k + shift < len(own) else None for k, w in enumerate(theirs)]
                for k in range(len(theirs) - n + 1):
                    part = same[k : k + n]
                    if None not in part:
                        best = max(best, sum(part))
            if best >= least:
                out[d, text, i] = best
    return sorted((d, i, b) for (d, _, i), b in out.items())


def fixture(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([9, 12, 13, 20, 40])))) for i in range(20)] + [(20, "Tiny item!"), (21, ""), (22, None), (23, "one two three four five six seven")]
    docs = []
    for d in range(120):
        body = text(rng.randint(0, 120))
        if d % 2:
            part = items[rng.randrange(len(items))][1] or ""
            part = part.split()
            for _ in range(rng.randint(0, max(len(part) // 5, 0))):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            cut = rng.randint(0, 3)
            body[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part[cut:]]
        docs.append((d, " ".join(body)))
    return docs, items


def test_against_all_alignments(spark):
    docs, items = fixture()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.agreeing) for r in got) == plain(docs, items)
    assert len(got) > 20


def test_rows_that_stay(spark, texts):
    docs = spark.createDataFrame([*texts, (1, "a text apart")], "doc_id long, text string").selectExpr("*", "1 as id", "'x' as seed", "2 as tie", "3 as found_id")
    items = spark.createDataFrame([(1, texts[0][1][:200]), (None, "two words"), (2, None)], "item_id long, text string")
    left = clean(docs, items)
    assert left.columns == docs.columns
    found = {t for _, t in texts if t and (texts[0][1][:25] in t or t == "two words")}  # one copy has a word changed
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((d, t) for d, t in [*texts, (1, "a text apart")] if t not in found), key=str)


def test_empty(spark, texts):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(none, items).collect() == []
    assert clean(spark.createDataFrame(texts, "doc_id long, text string"), items).count() == len(texts)
    assert contaminated(none, spark.createDataFrame([(1, texts[0][1])], "item_id long, text string")).collect() == []


def test_masks_meet_every_pattern_of_substitutions():
    for n in range(SPAN, WINDOW + 1):
        for wrong in combinations(range(n), n - needed(n)):
            assert any(not set(wrong) & {i + p for p in mask} for mask in MASKS for i in range(n - mask[-1]))
