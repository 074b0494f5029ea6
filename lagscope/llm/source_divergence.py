"""How far each source's use of words is from the other sources of its language.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A language keeps the
``V`` terms found in at least ``MIN_DOCS`` of its documents. A group (a language with one source,
or the whole language) gives a kept term ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))`` with
``count >= 0`` its occurrences in the group and ``N`` their sum over the kept terms; all arithmetic
is on exact integers.

Two parts per (lang, source):

* ``pair``: for every other source of the language, the L1 distance ``sum_t |p_s(t) - p_s'(t)|``
  over all kept terms (0 when V = 0), ranked.
* ``term``: the terms the source uses more than its language, ``p_s(t) - p_lang(t)`` with
  ``p_s(t) > p_lang(t)`` and count > 0, the first ``TOP`` by rank.

The distances are found by Gustavson's row accumulation, not by emitting posting pairs. A term a
group does not use has the group's baseline ``b = 1 + floor(5 10^9 / (N + 5 V))``, so the
distance starts at ``V |b_s - b_s'|`` and only the terms a group uses correct it. The postings
(language, term, source, p) are dealt to term blocks; in a block each source's row scatters into
a dense accumulator over the language's sources: for its own terms against the peers' baselines
(a sorted sweep and prefix sums, one per row), and through the term-major index of the block for
the peers that share a term. Each block sends at most sources^2 partial sums per language, which
Spark adds up. Counting terms is one scan with map-side aggregation and one shuffle by term, after
which only the kept terms' counts are written to the shared folder for all later branches; a
source holding a third of all rows is one group of at most V postings, and a language with most
postings is dealt over as many blocks as its share asks.

Null text, lang or source: ''. Empty and very long texts are read whole. Repeated rows count
every time. Ties in rank: UTF-8 item ascending. A language whose groups have no kept term:
``pair`` values 0, no ``term`` rows. A language with one source: no ``pair`` rows. Empty table:
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.session import store

# The term pattern, threshold, smoothing and scale of the contract.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what parts terms
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
POSTINGS_PER_BLOCK = 50_000  # postings a task of the accumulation holds, about
TOP_BLOCKS = 16  # the first TOP of a group are kept per block of terms before they meet

RESULT = "lang string, source string, part string, item string, value long, rank int"


def _share(count: str, total: str, vocabulary: str) -> F.Column:
    """``1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH vocabulary))`` on exact decimals."""
    d = "decimal(38,0)"
    return F.expr(f"1 + cast(cast({SCALE} as {d}) * cast({count} + {SMOOTH} as {d}) div cast({total} + {SMOOTH} * {vocabulary} as {d}) as bigint)")


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang, source, term, cnt, docs``: occurrences of each term in a group, and rows holding it.

    A text is split at runs of the characters that are not in terms; its terms are sorted inside
    the JVM and counted per run of equal ones, so each row sends one row per distinct term."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    terms = F.array_sort(F.filter(F.split(text, GAP), lambda x: x != ""))
    starts = F.expr("CASE WHEN size(s) = 0 THEN array() ELSE filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> s[i - 1]) END")
    runs = F.expr("transform(r, (p, j) -> named_struct('t', s[p], 'n', coalesce(get(r, j + 1), size(s)) - p))")
    return (
        documents.select(
            F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), terms.alias("s")
        )
        .select("lang", "source", "s", starts.alias("r"))
        .select("lang", "source", F.explode(runs).alias("e"))
        .groupBy("lang", "source", F.col("e.t").alias("term"))
        .agg(F.sum("e.n").alias("cnt"), F.count("*").alias("docs"))
    )


def _accumulate(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial distances of one language over one block of terms.

    ``rows`` has the language's sources (kind 1: index, baseline) and the block's postings
    (kind 0: index, term, p). Returns ``lang, a, b, acc`` for the sources a != b."""
    lang = rows["lang"].iloc[0]
    groups = rows[rows["kind"] == 1]
    size = int(groups["a"].max()) + 1
    base = np.zeros(size, np.int64)
    base[groups["a"].to_numpy()] = groups["p"].to_numpy(np.int64)
    post = rows[rows["kind"] == 0]
    acc = np.zeros((size, size), np.int64)
    if len(post):
        src = post["a"].to_numpy(np.int64)
        p = post["p"].to_numpy(np.int64)
        term = pd.factorize(post["term"])[0]
        gap = np.abs(base[:, None] - base[None, :])
        # Own terms of each row against every peer's baseline: a sweep over the row's sorted values.
        for s in np.unique(src):
            mine = np.sort(p[src == s])
            ahead = np.concatenate([[0], np.cumsum(mine)])
            k = np.searchsorted(mine, base, side="right")
            below = base * k - ahead[k]
            above = (ahead[-1] - ahead[k]) - base * (len(mine) - k)
            row = below + above - len(mine) * gap[s]
            acc[s] += row
            acc[:, s] += row
        # Peers that share a term: through the term-major index of the block.
        order = np.argsort(term, kind="stable")
        src, p, term = src[order], p[order], term[order]
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        width = np.diff(np.r_[start, len(term)])
        reach = np.repeat(width, width)  # for each posting, the postings of its term
        one = np.repeat(np.arange(len(term)), reach)
        offset = np.repeat(np.r_[0, np.cumsum(reach)[:-1]], reach)
        other = np.repeat(np.repeat(start, width), reach) + np.arange(len(one)) - offset
        keep = src[one] != src[other]
        i, j = one[keep], other[keep]
        si, sj = src[i], src[j]
        fix = np.abs(p[i] - p[j]) - np.abs(p[i] - base[sj]) - np.abs(base[si] - p[j]) + np.abs(base[si] - base[sj])
        np.add.at(acc, (si, sj), fix)
    a, b = np.nonzero(acc)
    return pd.DataFrame({"lang": lang, "a": a.astype(np.int64), "b": b.astype(np.int64), "acc": acc[a, b]})


def source_divergence(documents: DataFrame, blocks: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``: the two parts described in the module text.

    ``blocks``: term blocks per language for the accumulation (default: one per
    ``POSTINGS_PER_BLOCK`` postings), so a task holds a bounded share of the postings and the
    partial sums grow with the postings, not with the cluster."""
    # One shuffle of all terms: a term's rows (one per source) meet, and only kept terms are written.
    spread = Window.partitionBy("lang", "term")
    used = store(
        term_counts(documents).withColumn("_docs", F.sum("docs").over(spread)).where(F.col("_docs") >= MIN_DOCS).select("lang", "source", "term", "cnt"),
        "kept-term-counts",
    )
    kept = used.groupBy("lang", "term").agg(F.sum("cnt").alias("cnt"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("vocab"), F.sum("cnt").alias("total"))
    groups = (
        documents.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"))
        .distinct()
        .join(sizes.select("lang", "vocab"), "lang", "left")
        .join(used.groupBy("lang", "source").agg(F.sum("cnt").alias("total")), ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("vocab", F.lit(0)).alias("vocab"), F.coalesce("total", F.lit(0)).alias("total"))
        .withColumn("a", F.dense_rank().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("base", F.when(F.col("vocab") > 0, _share("0", "total", "vocab")))
    )
    postings = used.join(groups, ["lang", "source"]).select("lang", "source", "term", "a", "cnt", _share("cnt", "total", "vocab").alias("p"))
    own = sizes.select("lang", "vocab", "total")
    if blocks is None:
        blocks = max(1, -(-postings.count() // POSTINGS_PER_BLOCK))
    language = kept.join(own, "lang").select("lang", "term", _share("cnt", "total", "vocab").alias("q"))

    over = (
        postings.join(language, ["lang", "term"])
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    within = Window.partitionBy("lang", "source", "block").orderBy(F.desc("value"), "item")
    terms = (
        over.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(TOP_BLOCKS)))
        .withColumn("rank", F.row_number().over(within))
        .where(F.col("rank") <= TOP)  # the first TOP of every block hold the first TOP of the group
        .drop("block", "rank")
    )

    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block")
    scattered = postings.select("lang", block, F.lit(0).alias("kind"), "a", "term", "p").unionByName(
        groups.where("vocab > 0").select(
            "lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "a", F.lit(None).cast("string").alias("term"), F.col("base").alias("p")
        )
    )
    partial = (
        scattered.groupBy("lang", "block")
        .applyInPandas(_accumulate, "lang string, a long, b long, acc long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("acc").alias("acc"))
    )
    me = groups.select("lang", "source", "a", "vocab", F.col("base").alias("base_a"))
    peer = groups.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), F.col("base").alias("base_b"))
    pairs = (
        me.join(peer, "lang")  # every ordered pair of sources of a language: the result itself
        .where("a <> b")
        .join(partial, ["lang", "a", "b"], "left")
        .select(
            "lang",
            "source",
            F.lit("pair").alias("part"),
            "item",
            F.when(F.col("vocab") == 0, F.lit(0)).otherwise(F.col("vocab") * F.abs(F.col("base_a") - F.col("base_b")) + F.coalesce("acc", F.lit(0))).alias("value"),
        )
    )
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return (
        pairs.unionByName(terms)
        .withColumn("rank", F.row_number().over(ranked))
        .where((F.col("part") == "pair") | (F.col("rank") <= TOP))
        .select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))
    )
