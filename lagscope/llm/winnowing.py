"""Document fingerprints by winnowing, and how they hold up against an edit.

A text's code points give rolling hashes of every ``K``-gram (a polynomial hash over 64-bit
words, made from prefix sums so a whole text is one numpy pass, then mixed). Of every window of
``W`` consecutive hashes the least is chosen, the rightmost of equal ones, and each chosen hash is
kept once with the position of its k-gram. So every substring of ``K + W - 1`` code points that
two texts share gives both at least one equal hash, and substrings under ``K`` code points give
none. Likeness of two fingerprints is the Jaccard share of their distinct hashes.

``fingerprints(documents)`` also fingerprints an edited text: its last ``floor(n/3)`` code points
replaced by the first as many of the next document in descending doc_id (after the last, the
first). Spark range-partitions the rows by (doc_id descending, SHA-256 of the text, row id) and
sorts them, so the next document is the next row of the same task; only the last row of each task
waits for the first row of the next non-empty task, which one small aggregation per task and two
joins on task numbers bring to it. Texts are shuffled once; no row is ever compared with more
than its successor.

Null text: empty (no k-gram; empty fingerprint). A text of under ``K`` code points: one hash of the
whole text. Likeness of two empty fingerprints is 1, of an empty and another 0. Equal texts have
equal fingerprints. Null doc_id: after all others. Rows with the same doc_id: ordered by the
SHA-256 of their texts, and identical rows follow each other. One row: its own next. Empty table:
no rows. Texts of any length are read whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 16  # k-gram length in code points: shared strings shorter than this never match
W = 32  # window of k-gram hashes: shared strings of K + W - 1 code points always match
BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20  # windows compared at a time

RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, hashes array<long>, positions array<int>, "
    "edited_hashes array<long>, edited_positions array<int>, near_edited double, near_next double"
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words, so the least hash of a window is any k-gram alike."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kgram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every k-gram of the code points (one of the whole text when it is shorter)."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(K, n)
    with np.errstate(over="ignore"):
        ahead = np.zeros(n + 1, np.uint64)
        ahead[1:] = np.cumsum(codes.astype(np.uint64) * _powers(INVERSE, n), dtype=np.uint64)
        return _mix((ahead[k:] - ahead[:-k]) * _powers(BASE, n)[k - 1 :])


def winnow(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of every window of ``W``, rightmost of ties, each chosen k-gram once."""
    m = len(hashes)
    if m == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m <= W:
        at = np.array([m - 1 - int(np.argmin(hashes[::-1]))])
    else:
        picks = []
        for first in range(0, m - W + 1, CHUNK):
            view = sliding_window_view(hashes[first : min(m, first + CHUNK + W - 1)], W)[:, ::-1]
            picks.append(first + np.arange(len(view)) + W - 1 - np.argmin(view, axis=1))
        at = np.unique(np.concatenate(picks))  # chosen positions never move left
    return hashes[at], at


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprint(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text given as code points."""
    return winnow(kgram_hashes(codes))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard share of the distinct hashes of two fingerprints."""
    a, b = np.unique(a), np.unique(b)
    if len(a) == 0 and len(b) == 0:
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class _Doc:
    __slots__ = ("doc_id", "text", "codes", "hashes", "positions")

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.codes = code_points(self.text)
        self.hashes, self.positions = fingerprint(self.codes)


def _result(doc: _Doc, nxt: _Doc) -> dict:
    n = len(doc.codes)
    cut = n // 3
    edited_text = doc.text[: n - cut] + nxt.text[:cut]
    edited, at = fingerprint(np.concatenate([doc.codes[: n - cut], nxt.codes[:cut]]))
    return {
        "doc_id": doc.doc_id,
        "n_chars": n,
        "edited_sha256": hashlib.sha256(edited_text.encode("utf-8")).hexdigest(),
        "hashes": doc.hashes.view(np.int64),
        "positions": doc.positions.astype(np.int32),
        "edited_hashes": edited.view(np.int64),
        "edited_positions": at.astype(np.int32),
        "near_edited": likeness(doc.hashes, edited),
        "near_next": likeness(doc.hashes, nxt.hashes),
    }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _successors(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted task with the row after them; the task's last row waits for the next task."""
    before: _Doc | None = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc = _Doc(doc_id, text)
            if before is not None:
                out.append(_result(before, doc))
            before = doc
        if out:
            yield _batch(out, schema)


def _seams(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The last row of each task with the first row of the next one."""
    for batch in batches:
        out = [_result(_Doc(*last), _Doc(*first)) for last, first in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))]
        if out:
            yield _batch(out, schema)


def _schema(spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], RESULT).schema)


def fingerprints(documents: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, hashes, positions, edited_hashes,
    edited_positions, near_edited, near_next`` (hashes as signed longs of the 64-bit words)."""
    spark = documents.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").asc(), F.col("row").asc()]
    ranged = (
        documents.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("tie"), F.monotonically_increasing_id().alias("row"))
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
    )
    schema = _schema(spark)
    inner = ranged.select("doc_id", "text").mapInArrow(lambda b: _successors(b, schema), RESULT)

    # First and last row of every non-empty task, by the same sort key, in the JVM.
    key = F.struct(F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "tie", "row")
    ends = ranged.groupBy(F.spark_partition_id().alias("task")).agg(
        F.min_by(F.struct("doc_id", "text"), key).alias("first"), F.max_by(F.struct("doc_id", "text"), key).alias("last")
    )
    following = ends.select(
        "task",
        F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("then"),
    )  # one small row per task
    seams = (
        ends.select("task", "last")
        .join(following, "task")
        .join(ends.select(F.col("task").alias("then"), "first"), "then")
        .select("last.doc_id", "last.text", F.col("first.doc_id").alias("next_id"), F.col("first.text").alias("next_text"))
        .mapInArrow(lambda b: _seams(b, schema), RESULT)
    )
    return inner.unionByName(seams)
