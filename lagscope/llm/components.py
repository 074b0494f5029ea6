"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.session import store


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Each node with a link to a smaller one or a chain to it, as ``node``, and the smallest node it reaches,
    as ``root``. The roots themselves have no row.

    ``edges`` has long columns ``a`` and ``b``. Rounds of large-star and small-star steps: every
    round hangs neighbours on the smallest node near them, so no node's neighbours are gathered in
    one task, and each round is written to the shared folder, so a lost executor costs one round.
    The rounds end when nothing changes, which is a number that grows as the logarithm of the
    longest path.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = store(small.distinct(), name)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
