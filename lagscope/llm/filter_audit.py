"""How five text filters share their removals over all 120 orders, by Lehmer-rank difference arrays.

Every row gets a mask of the filters it fails. Rows are counted by (part, mask) with Spark's
partial aggregation, so only a few dozen rows per part leave the scan. A mask's rows are removed
by the first of its filters in an order; the orders in which that filter comes first among the
mask's filters are a few runs of lexicographic ranks, each a prefix of letters outside the mask
followed by that filter. The counts are added at the start of each run and taken away at its end,
and a running sum over the 120 ranks gives, for every order and filter, the rows that filter
removes. Work on documents is one scan and two aggregations; the rest is on tables of parts x 600.

Filters, failed when (words are maximal ``[^\\x20\\x09-\\x0D]+``, case-sensitive):
A under 200 words; B 100 x distinct words < 50 x words; C 100 x characters ``[A-Z]`` > 3 x code
points; D a character of ``[#$%&*|]``; E the same text as a row with a smaller doc_id, table-wide.

Null text: the empty text (fails A only). Null lang: part ''. Null doc_id: never smaller than
another, so such a row never fails E, nor makes another row fail it, and it has no labels. Repeated rows with the same
doc_id and text: neither is smaller, both count. A doc_id labelled several times counts as good
(toxic) if any of its labels is 1. Texts of any length are measured whole. Empty table: no rows.
Other columns of ``documents`` and ``labels``, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The filters and their thresholds as the contract states them.
LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 200
SYMBOLS = "[#$%&*|]"

ORDERS = ["".join(p) for p in permutations(LETTERS)]  # lexicographic: index = Lehmer rank


def lehmer_rank(order: str) -> int:
    """Position of an order of the five letters among all of them in lexicographic order."""
    rest, rank = sorted(order), 0
    for i, letter in enumerate(order):
        rank += rest.index(letter) * factorial(len(order) - 1 - i)
        rest.remove(letter)
    return rank


def runs(mask: int) -> list[tuple[int, int, int]]:
    """(filter, first rank, rank after the last) of every run of orders in which that filter is the first
    of the mask's filters. A run is all orders that begin with one arrangement of letters outside the
    mask and then the filter."""
    inside = [i for i in range(5) if mask >> i & 1]
    outside = [LETTERS[i] for i in range(5) if not mask >> i & 1]
    out = []
    for letter in inside:
        for k in range(len(outside) + 1):
            for prefix in permutations(outside, k):
                head = "".join(prefix) + LETTERS[letter]
                tail = sorted(set(LETTERS) - set(head))
                start = lehmer_rank(head + "".join(tail))
                out.append((letter, start, start + factorial(5 - len(head))))
    return out


def failures(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of documents counted by (part, mask, good, toxic), as ``part, mask, n, good, toxic``."""
    t, text = F.col("t"), F.coalesce(F.col("text"), F.lit(""))
    fails = (
        (F.size("words") < MIN_WORDS).cast("int")
        + (F.size(F.array_distinct("words")) * 100 < F.size("words") * 50).cast("int") * 2
        + (F.regexp_count(t, F.lit("[A-Z]")) * 100 > F.char_length(t) * 3).cast("int") * 4
        + t.rlike(SYMBOLS).cast("int") * 8
    )
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = (
        documents.select(
            F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text.alias("t")
        )
        .withColumn("words", F.regexp_extract_all(t, F.lit(WORD), 0))
        .select("doc_id", "part", "key", fails.alias("m4"))
        .join(marks, "doc_id", "left")
        .select("doc_id", "part", "key", "m4", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )
    # Repeated rows collapse here; copies of one text keep their own ids, so a large group of
    # copies is spread over tasks by doc_id.
    grouped = rows.groupBy("key", "doc_id", "part", "m4", "good", "toxic").agg(F.count("*").alias("n"))
    first = grouped.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        grouped.join(first, ["key", "doc_id"], "left")
        .groupBy("part", (F.col("m4") + later.cast("int") * 16).alias("mask"))
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the five filters and step: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley`` (see the contract in the module text)."""
    spark = documents.sparkSession
    masks = failures(documents, labels)
    spans = spark.createDataFrame([(m, letter, a, b) for m in range(1, 32) for letter, a, b in runs(m)], "mask int, letter int, a int, b int")
    steps = F.explode(
        F.array(*[F.struct(F.lit(r).alias("r"), F.lit(o).alias("filter_order"), F.lit(s + 1).alias("step"), F.lit(LETTERS.index(o[s])).alias("letter"))
                  for r, o in enumerate(ORDERS) for s in range(5)])
    )
    change = (
        masks.join(spans, "mask")
        .select(
            "part",
            "letter",
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("r"), "n", "good", "toxic"),
                    F.struct(F.col("b").alias("r"), (-F.col("n")).alias("n"), (-F.col("good")).alias("good"), (-F.col("toxic")).alias("toxic")),
                )
            ).alias("c"),
        )
        .where("c.r < 120")
        .groupBy("part", "letter", F.col("c.r").alias("r"))
        .agg(F.sum("c.n").alias("dn"), F.sum("c.good").alias("dg"), F.sum("c.toxic").alias("dt"))
    )
    per_part = masks.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)).alias(f"fails{i}") for i in range(5)],
        *[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only{i}") for i in range(5)],
    )
    running = Window.partitionBy("part", "letter").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_orders = Window.partitionBy("part", "letter")
    earlier = Window.partitionBy("part", "r").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    letter = F.col("letter")
    pick = lambda prefix: F.element_at(F.array(*[F.col(f"{prefix}{i}") for i in range(5)]), letter + 1)
    out = (
        per_part.select("*", steps.alias("o"))  # parts x 600 rows: the result itself
        .select("*", "o.*")
        .drop("o")
        .join(change, ["part", "letter", "r"], "left")
        .withColumn("removed", F.sum(F.coalesce("dn", F.lit(0))).over(running))
        .withColumn("good_lost", F.sum(F.coalesce("dg", F.lit(0))).over(running))
        .withColumn("toxic_lost", F.sum(F.coalesce("dt", F.lit(0))).over(running))
        .withColumn("shapley", F.sum("removed").over(all_orders))
        .withColumn("kept", F.col("total") - F.sum("removed").over(earlier))
    )
    return out.select(
        "part",
        "filter_order",
        "step",
        F.col("kept").cast("long"),
        F.col("removed").cast("long"),
        (pick("fails") - F.col("removed")).cast("long").alias("redundant"),
        pick("only").cast("long").alias("unique_fails"),
        F.col("good_lost").cast("long"),
        F.col("toxic_lost").cast("long"),
        F.col("shapley").cast("long"),
    )
