"""Exact vector search by cosine, and searches built on it.

Vectors are input columns. Exact search goes through the inverted file of ``ivf``: a query is
scored only against the cells that can hold one of its best ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import cosine
from . import ivf

# Scores are compared in units of 1e-9, so that the id decides between copies of a vector and
# not the order of additions.
RANK_SCALE = 1e9
LSH_TABLES, LSH_BITS = 8, 8


def retrieval_query_text(worst: DataFrame) -> DataFrame:
    """Texts to embed for the incident and runbook searches of each worst topic."""
    velocity = F.bround("lag_velocity_per_min", 0).cast("bigint")
    minus_zero = (F.col("lag_velocity_per_min") < 0) & (velocity == 0)
    symptoms = F.concat(
        F.lit("lag="), F.col("total_lag").cast("string"),
        F.lit(" velocity="), F.when(minus_zero, "-0").otherwise(velocity.cast("string")), F.lit("/min"),
    )
    return worst.select(
        "snapshotted_at",
        F.concat_ws(
            " ", "lag_classification", F.lit("consumer group"), "group_id", F.lit("topic"), "topic", symptoms
        ).alias("incident_query"),
        F.concat(
            F.col("lag_classification"), F.lit(" kafka consumer group runbook topic="), F.col("topic")
        ).alias("runbook_query"),
    )


def cosine_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add the cosine of two vector columns."""
    return pairs.withColumn("score", cosine(F.col(a), F.col(b)))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float, match: tuple[str, str] | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of each query with cosine of at least ``threshold``.

    ``queries`` has (query_id, embedding), ``corpus`` (id, embedding). ``match`` names a query
    column and an array column of the corpus that must contain its value. One path at every size:
    the inverted file of ``ivf``, probed nearest cell first and completed by the cells whose radius
    bound reaches the k-th score, so the result is exact and no pair of blocks is scored whole.
    A query is compared with the vectors of its own length; there may be several lengths.
    """
    q = queries.select("query_id", "embedding", *([F.col(match[0]).alias("_match")] if match else []))
    c = corpus.select("id", "embedding", *([F.col(match[1]).alias("_tags")] if match else []))
    return ivf.vector_topk_ivf(q, c, k, threshold)


def similar_incidents(
    queries: DataFrame, chunks: DataFrame, k: int = 5, overfetch: int = 4, threshold: float = 0.5
) -> DataFrame:
    """The ``k`` most similar incidents of each query.

    Of the ``k * overfetch`` nearest chunks the best of each incident counts; the others are
    dropped after that limit, not before it.
    """
    hits = vector_topk(queries, chunks, k * overfetch, threshold).select(
        "query_id", "id", "score", "rank_score"
    )
    payload = [c for c in chunks.columns if c != "embedding"]
    # A chunk without an incident stands for itself.
    found = hits.join(chunks.select(*payload), "id").withColumn(
        "incident_id", F.coalesce("incident_id", F.col("id").cast("string"))
    )
    by_score = [F.desc("rank_score"), F.col("id")]
    best = (
        found.withColumn(
            "_n", F.row_number().over(Window.partitionBy("query_id", "incident_id").orderBy(*by_score))
        )
        .filter("_n = 1")
        .drop("_n")
    )
    w = Window.partitionBy("query_id").orderBy(*by_score)
    return (
        best.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= k)
        .select(
            "query_id",
            "position",
            "incident_id",
            F.col("score").alias("similarity_score"),
            F.coalesce("lag_classification", F.lit("UNKNOWN")).alias("lag_classification"),
            F.coalesce("consumer_group", F.lit("")).alias("consumer_group"),
            F.coalesce("topic", F.lit("")).alias("topic"),
            F.coalesce("resolution_type", F.lit("UNKNOWN")).alias("resolution_type"),
            F.coalesce("time_to_resolution_minutes", F.lit(0)).alias("time_to_resolution_minutes"),
            F.coalesce("summary", F.lit("")).alias("summary"),
        )
    )


def runbook_search(
    queries: DataFrame, chunks: DataFrame, k: int = 3, overfetch: int = 2, threshold: float = 0.4
) -> DataFrame:
    """The ``k`` nearest runbook sections tagged with the class of each query.

    ``overfetch`` widens the search as the caller of a vector store would; without
    de-duplication it does not change the result.
    """
    hits = vector_topk(
        queries, chunks, k * overfetch, threshold, ("lag_classification", "lag_classifications")
    ).filter(F.col("position") <= k)
    return hits.join(chunks.drop("embedding", "lag_classifications"), "id").select(
        "query_id",
        "position",
        "runbook_id",
        "title",
        "section",
        "content",
        F.col("score").alias("relevance_score"),
    )


def sign_planes(dims: int, tables: int, bits: int) -> np.ndarray:
    """Fixed hyperplanes, one row each: every machine and every run makes the same ones."""
    k = np.arange(1, tables * bits + 1, dtype=np.int64)[:, None]
    d = np.arange(1, dims + 1, dtype=np.int64)[None, :]
    factor = (k * k * 40503 + k * 9973 + 12345) % 65521
    return (d * d * 17 + d * factor + k * 31) % 65521 / 65521.0 - 0.5


def sign_buckets(vectors: DataFrame, key: str, tables: int = LSH_TABLES, bits: int = LSH_BITS) -> DataFrame:
    """Index of a vector table: rows (key, dims, table_no, bucket), one for each table.

    A bucket is the sides of ``bits`` hyperplanes that a vector lies on, so close vectors share one in
    some table. Can be stored once and used for many searches.
    """
    source = vectors.filter("embedding is not null").select(key, "embedding")
    schema = T.StructType([source.schema[key]])
    schema = schema.add("dims", T.IntegerType()).add("table_no", T.IntegerType()).add("bucket", T.LongType())

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["embedding"].map(len)):
                x = np.stack([np.asarray(v, dtype="float64") for v in part["embedding"]])
                side = (x @ sign_planes(n, tables, bits).T >= 0).reshape(len(x), tables, bits)
                bucket = side @ (1 << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame(
                    {
                        key: np.repeat(part[key].to_numpy(), tables),
                        "dims": np.int32(n),
                        "table_no": np.tile(np.arange(tables, dtype=np.int32), len(x)),
                        "bucket": bucket.reshape(-1),
                    }
                )

    return source.mapInPandas(index, schema)


def vector_topk_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    threshold: float,
    index: DataFrame | None = None,
    tables: int = LSH_TABLES,
    bits: int = LSH_BITS,
) -> DataFrame:
    """Search for large corpora: a query is compared with the rows that share a bucket with it.

    May miss rows that ``vector_topk`` finds; what it returns has exact scores and order. ``index`` is
    a stored ``sign_buckets`` of the corpus with the same parameters. More bits look at fewer rows,
    more tables miss fewer. Buckets with very many rows are split by adaptive execution, which can
    part the corpus side of the join.
    """
    if index is None:
        index = sign_buckets(corpus, "id", tables, bits)
    wanted = sign_buckets(queries, "query_id", tables, bits)
    pairs = index.join(wanted, ["dims", "table_no", "bucket"]).select("query_id", "id").distinct()
    scored = (
        pairs.join(corpus.select("id", "embedding"), "id")
        .join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        .select("query_id", "id", cosine(F.col("_q"), F.col("embedding")).alias("score"))
        .filter(F.col("score") >= threshold)
        .withColumn("rank_score", F.rint(F.col("score") * RANK_SCALE).cast("bigint"))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "id")
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
