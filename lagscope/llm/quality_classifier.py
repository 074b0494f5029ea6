"""A quality classifier by co-training on two views of a document.

The content view sees words: their lengths, endings, repetition and variety. The metadata view sees
what a page's record tells without reading words: language, source, size, lines and the shares of
kinds of bytes. Each view has a logistic model. In every round, each model labels the pool of
unlabelled documents, and the pseudo-labels it is most sure of are given to the other view's
training set. Then each view is calibrated on labelled documents that neither saw, and a
logistic model of the two calibrated log-odds scores all documents.

Bounds: training uses at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, chosen by hash of
the id; only their features, of fixed length, reach the driver. All documents are scored on
their whole texts.

Null or empty texts: features of a text without words. Null language or source: a value of its own.
Null doc_id: scored, never used for training. Repeated rows are scored each. Without labels of both
classes every score is 1.0 if any label is good or there is none, else 0.0. Empty tables: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lagscope.llm.arrays import find_words, mix, small_batches, text_bytes, word_array, word_ids
from lagscope.llm.logistic import fit, predict

LABELLED = 4000
POOL = 4000
ROUNDS = 4
SURE = 0.95
PER_ROUND = 0.1
ENDINGS = 128
LENGTHS = 16
SOURCES = 32
LANGUAGES = 8

KIND = np.zeros(256, np.int64)  # 0: other
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 4
for _k, _c in enumerate(b" \n\t.,;:!?|*%$&#<>()[]{}'\"-_/\\@=+~^`", 5):
    KIND[_c] = _k
KINDS = int(KIND.max()) + 1


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text."""
    docs = len(offsets) - 1
    start, end, doc, inside = find_words(data, offsets)
    ids, _ = word_ids(word_array(data, inside, start, end))
    n = np.bincount(doc, minlength=docs)
    many = np.maximum(n, 1)
    per_doc = lambda weight: np.bincount(doc, weights=weight, minlength=docs) / many
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    pairs = np.unique(doc << 32 | ids)
    distinct = np.bincount(pairs >> 32, minlength=docs)
    if len(ids):
        tail = data[end - 1].astype(np.uint64) << np.uint64(8) | data[np.maximum(end - 2, start)]
        ending = (mix(tail) % np.uint64(ENDINGS)).astype(np.int64)
        length = np.minimum(end - start, LENGTHS) - 1
    else:
        ending = length = np.zeros(0, np.int64)
    spread = lambda key, size: np.bincount(doc * size + key, minlength=docs * size).reshape(docs, size) / many[:, None]
    columns = [np.log1p(n), distinct / many, np.log1p(distinct), per_doc(same), per_doc(end - start) / 10]
    return np.column_stack([*columns, spread(ending, ENDINGS), spread(length, LENGTHS)])


def metadata_features(data: np.ndarray, offsets: np.ndarray, lang: pa.Array, source: pa.Array) -> np.ndarray:
    """Record and layout of each text."""
    docs = len(offsets) - 1
    sizes = np.diff(offsets)
    many = np.maximum(sizes, 1)
    owner = np.repeat(np.arange(docs), sizes)
    kinds = np.bincount(owner * KINDS + KIND[data], minlength=docs * KINDS).reshape(docs, KINDS) / many[:, None]
    lines = np.bincount(owner, weights=data == 10, minlength=docs) + 1

    def bucket(column: pa.Array, size: int) -> np.ndarray:
        at = [0 if v is None else 1 + zlib.crc32(v.encode()) % (size - 1) for v in column.to_pylist()]
        return np.eye(size)[at] if docs else np.zeros((0, size))

    return np.column_stack([np.log1p(sizes), np.log1p(lines), np.log1p(sizes / lines), kinds, bucket(lang, LANGUAGES), bucket(source, SOURCES)])


class View:
    """A standardised logistic model."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.beta = fit((x - self.mean) / self.scale, y, weight)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return predict(np.clip((x - self.mean) / self.scale, -8, 8), self.beta)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))[:, None]


class CoTrained:
    """Both views, their calibration and their combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS):
        """``views`` and ``pool``: features of labelled and unlabelled documents in each view."""
        kept = np.arange(len(y)) % 3 == 0  # for calibration only
        sets = [(v[~kept], y[~kept].astype(float)) for v in views]
        free = [np.ones(len(pool[0]), bool) for _ in views]
        self.models = [View(*s) for s in sets]
        for _ in range(rounds):
            for k, other in ((0, 1), (1, 0)):
                sure_of = fit(log_odds(self.models[k].chance(views[k][kept])), y[kept])  # an overfitted view is not sure
                p = predict(log_odds(self.models[k].chance(pool[k])), sure_of)
                most = max(int(PER_ROUND * len(p)), 1)
                for value, sure in ((1.0, p), (0.0, 1 - p)):
                    order = np.argsort(-sure, kind="stable")
                    take = order[(sure[order] >= SURE) & free[other][order]][:most]
                    free[other][take] = False
                    x, labels = sets[other]
                    sets[other] = np.concatenate((x, pool[other][take])), np.concatenate((labels, np.full(len(take), value)))
            self.models = [View(*s) for s in sets]
        both = kept if len(np.unique(y[kept])) == 2 else np.ones(len(y), bool)
        odds = [log_odds(m.chance(v[both])) for m, v in zip(self.models, views, strict=True)]
        self.calibration = [fit(o, y[both]) for o in odds]
        self.combination = fit(np.hstack([log_odds(predict(o, c)) for o, c in zip(odds, self.calibration, strict=True)]), y[both])

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, content and metadata probability of good quality."""
        own = [predict(log_odds(m.chance(v)), c) for m, v, c in zip(self.models, views, self.calibration, strict=True)]
        return predict(np.hstack([log_odds(p) for p in own]), self.combination), own[0], own[1]


def features(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of a batch with text, lang and source."""
    at = batch.schema.get_field_index
    data, offsets = text_bytes(batch.column(at("text")))
    return [content_features(data, offsets), metadata_features(data, offsets, batch.column(at("lang")).cast(pa.string()), batch.column(at("source")).cast(pa.string()))]


def _sample(docs: DataFrame, chosen: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a bounded set of documents, in order of id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            a, b = features(batch)
            rows = np.column_stack([a, b]).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.float32()))
            split = pa.array(np.full(len(rows), a.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), split, lists], ["doc_id", "label", "split", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").join(F.broadcast(chosen), "doc_id")
    got = sorted(rows.select("doc_id", "label", "text", "lang", "source").mapInArrow(run, "doc_id long, label int, split int, x array<float>").collect())
    if not got:
        return [np.zeros((0, 1)), np.zeros((0, 1))], np.zeros(0)
    x = np.array([r.x for r in got], float)
    return [x[:, : got[0].split], x[:, got[0].split :]], np.array([-1 if r.label is None else r.label for r in got])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS) -> CoTrained | float:
    """The co-trained model, or the one score of all documents if the labels have not both classes."""
    known = labels.selectExpr("cast(doc_id as long) as doc_id", "cast(quality as int) as label").where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")
    views, y = _sample(docs, known.orderBy(*order).limit(labelled))
    if len(np.unique(y)) < 2:
        return 1.0 if not len(y) or y[0] == 1 else 0.0
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    free = ids.join(known, "doc_id", "left_anti").orderBy(*order).limit(pool).withColumn("label", F.lit(None).cast("int"))
    unlabelled, _ = _sample(docs, free)
    if not len(unlabelled[0]):
        unlabelled = [v[:0] for v in views]
    return CoTrained(views, y, unlabelled, rounds)


def scored(docs: DataFrame, model: CoTrained | float, prefix: str = "quality_") -> DataFrame:
    """All columns of the documents, and three of scores whose names begin with ``prefix``."""
    names = [f"{prefix}{n}" for n in ("score", "content", "metadata")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            own = [np.full(batch.num_rows, model)] * 3 if isinstance(model, float) else model.score(features(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own)], [*batch.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name in names:
        schema = schema.add(name, DoubleType())
    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, kept, and the score of each view."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    out = scored(rows, train(docs, labels))
    return out.select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).alias("kept"), "quality_content", "quality_metadata")


def good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the classifier does not reject, all columns."""
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):  # a prefix that no column has
        prefix = f"_{prefix}"
    out = scored(docs, train(docs, labels), prefix)
    return out.where(F.col(f"{prefix}score") >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
