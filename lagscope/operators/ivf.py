"""Vector search through an inverted file: k-means cells, probed nearest first, completed exactly.

The cells are fitted by spherical k-means on a bounded sample (``SAMPLE_ROWS`` rows, the least
hashes of their ids); then every corpus row is assigned to its nearest cell and the cell keeps the
largest distance of a member from its centre (its radius). That is the index; it can be stored once
and used for many searches.

A search probes the ``probes`` cells whose centres are nearest each query, scores their rows
exactly and keeps the best ``k``. For unit vectors ``q . x = 1 - |q - x|^2 / 2`` and
``|q - x| >= |q - c| - radius``, so a cell can hold nothing better than
``1 - max(0, |q - c| - radius)^2 / 2``. A second round probes, per query, exactly the cells whose
bound reaches the k-th score found (or the threshold, when fewer than ``k`` were found) and were
not probed yet; after it the result is the exact ``vector_topk``, with no pair of blocks scored
whole. ``exact=False`` stops after the first round: that is the index's recall, measured in tests.

Every join is on (dims, cell, part): a cell's rows are dealt over ``SPLIT`` parts by a hash of
their id and the probes go to every part, so a cell that holds a third of the corpus (one vector
repeated) is scored by ``SPLIT`` tasks. The best ``k`` are kept per (query, part) before they meet.

Rows without a vector are left out; a zero vector scores null and is never returned. Several
vector lengths: each is its own index. Ties: rounded score, then id. Empty corpus or queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine

SAMPLE_ROWS = 20_000  # rows the cells are fitted on
ITERATIONS = 20
PROBES = 4
SPLIT = 16
RANK_SCALE = 1e9
SLACK = 1e-9  # bounds are compared with this much room for rounding


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _kmeans(x: np.ndarray, cells: int, iterations: int) -> np.ndarray:
    """Spherical k-means with a fixed k-means++ start: unit centres."""
    rng = np.random.default_rng(0)
    distinct = np.unique(x, axis=0)
    cells = max(1, min(cells, len(distinct)))
    centres = [distinct[rng.integers(len(distinct))]]
    for _ in range(1, cells):
        gap = np.maximum(0.0, 1.0 - (distinct @ np.stack(centres).T).max(axis=1))
        total = gap.sum()
        centres.append(distinct[rng.choice(len(distinct), p=gap / total)] if total > 0 else distinct[len(centres)])
    c = np.stack(centres)
    for _ in range(iterations):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def fit_cells(corpus: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, iterations: int = ITERATIONS) -> dict[int, np.ndarray]:
    """Cell centres for each vector length, fitted on at most ``sample_rows`` rows.

    ``cells`` defaults to the square root of the corpus rows (at most a tenth of the sample)."""
    rows = corpus.filter("embedding is not null")
    if cells is None:
        cells = max(1, min(int(round(rows.count() ** 0.5)), sample_rows // 10))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("embedding").toPandas()
    if sample.empty:
        return {}
    out = {}
    for n, part in sample.groupby(sample["embedding"].map(len)):
        out[int(n)] = _kmeans(_unit(part["embedding"]), cells, iterations)
    return out


def assign(corpus: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """The index: ``id, dims, cell, part, reach, embedding`` for every corpus row with a vector."""
    extra = [c for c in corpus.columns if c == "_tags"]  # tags a query may ask for
    source = corpus.filter("embedding is not null").select("id", "embedding", *extra)
    schema = f"id {source.schema['id'].dataType.simpleString()}, dims int, cell int, reach double, embedding {source.schema['embedding'].dataType.simpleString()}"
    schema += "".join(f", {c} {source.schema[c].dataType.simpleString()}" for c in extra)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["embedding"].map(len)):
                if n not in centres:
                    continue
                sims = _unit(part["embedding"]) @ centres[n].T
                cell = np.argmax(sims, axis=1)
                best = sims[np.arange(len(cell)), cell]
                out = pd.DataFrame({"id": part["id"], "dims": np.int32(n), "cell": cell.astype(np.int32), "reach": np.sqrt(np.maximum(0.0, 2.0 - 2.0 * best)), "embedding": part["embedding"]})
                for c in extra:
                    out[c] = part[c]
                yield out

    return source.mapInPandas(near, schema).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPLIT)).cast("int"))


def radii(index: DataFrame) -> dict[int, np.ndarray]:
    """Largest distance of a member from its centre, per cell (-1: an empty cell)."""
    out: dict[int, dict[int, float]] = {}
    for row in index.groupBy("dims", "cell").agg(F.max("reach").alias("r")).collect():  # one row per cell
        out.setdefault(row.dims, {})[row.cell] = row.r
    return {n: cells for n, cells in out.items()}


def _probes(queries: DataFrame, centres: dict[int, np.ndarray], radius: dict[int, dict[int, float]], probes: int, second: bool) -> DataFrame:
    """Cells to score for each query: the nearest ``probes``, or the others whose bound reaches ``floor``."""
    kind = queries.schema["query_id"].dataType.simpleString()
    emb = queries.schema["embedding"].dataType.simpleString()
    extra = [c for c in queries.columns if c == "_match"]
    cols = ["query_id", "embedding"] + extra + (["floor"] if second else [])
    schema = f"query_id {kind}, dims int, cell int, _q {emb}" + "".join(f", {c} {queries.schema[c].dataType.simpleString()}" for c in extra)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["embedding"].map(len)):
                if n not in centres:
                    continue
                c = centres[n]
                q = _unit(part["embedding"])
                sims = q @ c.T
                order = np.lexsort((np.broadcast_to(np.arange(len(c)), sims.shape), -sims), axis=1)
                first = np.zeros(sims.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                r = np.array([radius.get(n, {}).get(i, -1.0) for i in range(len(c))])
                if second:
                    gap = np.maximum(0.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims)) - r)
                    chosen = ~first & (1.0 - gap * gap / 2.0 >= part["floor"].to_numpy()[:, None] - SLACK)
                else:
                    chosen = first
                chosen &= r >= 0
                qi, ci = np.nonzero(chosen)
                out = pd.DataFrame({"query_id": part["query_id"].to_numpy()[qi], "dims": np.int32(n), "cell": ci.astype(np.int32), "_q": part["embedding"].to_numpy()[qi]})
                for name in extra:
                    out[name] = part[name].to_numpy()[qi]
                yield out

    return queries.select(*cols).mapInPandas(pick, schema).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))
    )


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query, kept per part first."""
    order = [F.desc("rank_score"), F.col("id")]
    local = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("_n") <= k)
    return local.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("position") <= k).drop("_n")


def _scored(probes: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    matched = "_match" in probes.columns
    found = probes.join(index.select("dims", "cell", "part", "id", "embedding", *(["_tags"] if matched else [])), ["dims", "cell", "part"])
    if matched:
        found = found.where(F.array_contains("_tags", F.col("_match")))
    return (
        found.select("query_id", "id", "part", cosine(F.col("_q"), F.col("embedding")).alias("score"))
        .where(F.col("score") >= threshold)
        .withColumn("rank_score", F.rint(F.col("score") * RANK_SCALE).cast("bigint"))
    )


def vector_topk_ivf(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    threshold: float,
    index: DataFrame | None = None,
    centres: dict[int, np.ndarray] | None = None,
    probes: int = PROBES,
    exact: bool = True,
) -> DataFrame:
    """``query_id, id, score, rank_score, position``: the ``k`` nearest rows of each query with cosine
    of at least ``threshold``. ``index`` and ``centres``: a stored ``assign`` and its ``fit_cells``.

    A query column ``_match`` keeps only corpus rows whose array column ``_tags`` holds its value."""
    if centres is None:
        centres = fit_cells(corpus)
    if index is None:
        index = assign(corpus, centres)
    radius = radii(index)
    asked = queries.filter("embedding is not null").select("query_id", "embedding", *[c for c in queries.columns if c == "_match"])
    first = _best(_scored(_probes(asked, centres, radius, probes, False), index, threshold), k)
    if not exact:
        return first.drop("part")
    floor = first.groupBy("query_id").agg(F.count("*").alias("_found"), F.min("rank_score").alias("_kth"))
    level = F.when(F.col("_found") >= k, F.greatest(F.col("_kth") / RANK_SCALE, F.lit(threshold))).otherwise(F.lit(threshold))
    more = asked.join(floor, "query_id", "left").select(*asked.columns, level.alias("floor"))
    second = _scored(_probes(more, centres, radius, probes, True), index, threshold)
    return _best(first.drop("position").unionByName(second), k).drop("part")
