"""Toxicity by compression distance to two zstandard dictionaries.

Training, on at most ``SAMPLE`` labelled documents of each class (by hash of the id): words are
counted by the different words that precede them, so copies of a document count once. The toxic
dictionary holds the words that toxic documents use clearly more often, the ordinary dictionary the
words frequent in ordinary ones; rare words are in neither.

Scoring: each window is one word of the text between two spaces, up to ``WINDOW`` bytes; a longer
word is cut into several windows. It is compressed with each dictionary, and its distance is the
saving of the toxic one over the ordinary one. Every byte is written as three bytes of a fixed
table first, so that a phrase that is in a dictionary costs far less than one that is not even for
short words, and a fixed prefix keeps windows long enough for the compressor to try. Distances are counted
against thresholds and turned into a probability by a logistic fit on sampled documents that were
not used for the dictionaries, weighted to the classes' real shares: the calibrated threshold is 0.5.

Labels are learnt only where crc32(doc_id as text) mod 5 is not 0. Label, language, source and id are
no inputs of a score. Null and empty texts have no windows and get the score of a text without any
sign. Rows with a null id are scored, held_out is null. Repeated rows are scored each. Without labels
of both classes all scores are the share of toxic labels, or 0. Empty tables: no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.llm.arrays import LOWER, find_words, small_batches, text_bytes, word_array, word_ids
from lagscope.llm.logistic import fit, predict

SAMPLE = 3000
WINDOW = 48
LEVEL = 9
THRESHOLDS = (4, 6, 8, 10, 12, 14)
TOXIC_SHARE = 0.01
CONTRAST = 3
ORDINARY_SHARE = 0.002
CACHE = 400_000

PREFIX = bytes(range(128, 192))
_TABLE = np.stack([np.arange(256), *(np.random.default_rng(k).permutation(256) for k in (1, 2))], axis=1).astype(np.uint8)


def wide(text: bytes) -> bytes:
    """Three bytes for each byte."""
    return _TABLE[np.frombuffer(text, np.uint8)].tobytes()


class Distances:
    """Distances of words, kept for words seen before up to a number of entries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self._compressor(toxic), self._compressor(ordinary)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content + PREFIX, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def window(self, part: bytes) -> int:
        sample = PREFIX + wide(b" " + part + b" ")
        return len(self.ordinary.compress(sample)) - len(self.toxic.compress(sample))

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        out = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            got = self.known.get(word)
            if got is None:
                got = self.known[word] = max(self.window(word[at : at + WINDOW]) for at in range(0, len(word), WINDOW))
            out[i] = got
        return out

    def features(self, text: pa.Array) -> np.ndarray:
        """Of each text: the largest distance, and how many and what share of windows pass each threshold."""
        data, offsets = text_bytes(text)
        docs = len(offsets) - 1
        data = LOWER[data]
        start, end, doc, inside = find_words(data, offsets)
        ids, distinct = word_ids(word_array(data, inside, start, end))
        distance = self.of(distinct.to_pylist())[ids] if len(ids) else np.zeros(0, np.int64)
        n = np.maximum(np.bincount(doc, minlength=docs), 1)
        most = np.zeros(docs, np.int64)
        np.maximum.at(most, doc, distance)
        columns = [most / 10]
        for t in THRESHOLDS:
            count = np.bincount(doc, weights=distance >= t, minlength=docs)
            columns += [np.log1p(count), np.log1p(100 * count / n)]
        return np.stack(columns, axis=1)


@lru_cache(maxsize=1)
def shared_distances(toxic: bytes, ordinary: bytes) -> Distances:
    """One for each Python process, which serves several tasks."""
    return Distances(toxic, ordinary)


def _contexts(texts: list[str], vocabulary: dict[bytes, int]) -> np.ndarray:
    """For each word of the vocabulary, which grows, how many different words precede it."""
    pairs = [np.zeros(0, np.int64)]
    for text in texts:
        data = LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
        ids = [0, *(vocabulary.setdefault(w, len(vocabulary) + 1) for w in data.split())]
        pairs.append(np.array([b << 32 | a for a, b in pairwise(ids)], np.int64))
        if len(pairs) > 200:
            pairs = [np.unique(np.concatenate(pairs))]
    found = np.unique(np.concatenate(pairs)) >> 32
    return np.bincount(found, minlength=len(vocabulary) + 1)


def build_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Dictionary content of each class, the most frequent words last."""
    vocabulary: dict[bytes, int] = {}
    in_toxic = _contexts(toxic, vocabulary)
    in_ordinary = _contexts(ordinary, vocabulary)
    in_toxic = np.pad(in_toxic, (0, len(in_ordinary) - len(in_toxic)))
    words = [b"", *vocabulary]
    a, b = max(len(toxic), 1), max(len(ordinary), 1)
    own = (in_toxic >= max(TOXIC_SHARE * a, 8)) & (in_toxic / a > CONTRAST * (in_ordinary + 1) / b)
    common = (in_ordinary >= max(ORDINARY_SHARE * b, 2)) & ~own

    def content(chosen: np.ndarray, count: np.ndarray) -> bytes:
        order = sorted(np.flatnonzero(chosen).tolist(), key=lambda i: (count[i], words[i]))
        return wide(b" " + b" ".join(words[i] for i in order) + b" ")

    return content(own, in_toxic), content(common, in_ordinary)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries and the coefficients of the calibration, from rows that are not held out."""
    known = (
        labels.selectExpr("cast(doc_id as long) as doc_id", "cast(toxic as int) as toxic")
        .where("toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    shares = dict(known.groupBy("toxic").count().collect())
    chosen = known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionAll(
        known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )  # at most 2 * sample rows, so it may be broadcast
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(F.broadcast(chosen), "doc_id")
    halves: dict[tuple[int, int], list[str]] = {(c, h): [] for c in (0, 1) for h in (0, 1)}
    for text, toxic, half in texts.select("text", "toxic", F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 3).orderBy("text").toLocalIterator():
        halves[toxic, int(half == 0)].append(text or "")
    toxic, ordinary = build_dictionaries(halves[1, 0], halves[0, 0])
    model = Distances(toxic, ordinary)
    size = 1 + 2 * len(THRESHOLDS)
    if not (halves[1, 1] and halves[0, 1]):
        rate = shares.get(1, 0) / max(sum(shares.values()), 1)
        return toxic, ordinary, np.append(np.zeros(size), np.log(rate / (1 - rate)) if 0 < rate < 1 else 500 * (2 * rate - 1))
    x = np.concatenate([model.features(pa.array(halves[c, 1], pa.string())) for c in (0, 1)])
    y = np.repeat([0, 1], [len(halves[0, 1]), len(halves[1, 1])])
    weight = np.array([shares[c] / len(halves[c, 1]) for c in (0, 1)])[y]
    return toxic, ordinary, fit(x, y, weight * len(y) / weight.sum())


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of (doc_id, text)."""
    toxic, ordinary, beta = train(docs, labels, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_distances(toxic, ordinary)
        for batch in small_batches(batches):
            score = predict(model.features(batch.column(1)), beta)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
