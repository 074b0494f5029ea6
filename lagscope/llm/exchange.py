"""Questions and answers between chunks of a corpus and hash buckets.

A chunk is one row that holds some documents, packed. Tasks over chunks send each bucket its part
of their keys as one packed row; the task of a bucket sees the keys of all chunks together and
answers each row in the order it came. Chunks are written bucketed by their number, so that answers
come back to them without shuffling the chunks again. Everything is a table that Spark wrote: a lost
executor costs a re-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.session import working_dir

PARCEL = "bucket int, chunk long, payload binary, stats array<long>"
NOTE = -1  # the chunk of payloads that are for all


def write_chunks(rows: DataFrame, name: str) -> DataFrame:
    """Write rows with a column ``chunk``, bucketed by it, to the shared folder."""
    spark = rows.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(parts, "chunk").option("path", working_dir(spark, name)).saveAsTable(table)
    return spark.table(table)


def parcels(rows: list[tuple[int, int, bytes]], stats: list[int] | None = None) -> pa.RecordBatch:
    """Rows of a table of parcels; the numbers of ``stats`` stand in the first."""
    bucket, chunk, payload = zip(*rows, strict=True) if rows else ((), (), ())
    numbers = [stats if i == 0 else None for i in range(len(rows))]
    arrays = [pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(payload, pa.binary()), pa.array(numbers, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "payload", "stats"])


def ask(chunks: DataFrame, question: Callable[..., Iterator[tuple[int, bytes]]], *columns: str) -> DataFrame:
    """Parcels of all chunks: ``question`` gets the given columns of one chunk and yields (bucket, payload)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = row.pop("chunk")
                for bucket, payload in question(**row):
                    yield parcels([(bucket, chunk, payload)])

    return chunks.select("chunk", *columns).mapInArrow(run, PARCEL)


class Reply(NamedTuple):
    """What a bucket answers."""

    payloads: list[bytes]  #: one for each payload asked, in order
    stats: list[int] | None = None  #: numbers to add up over buckets
    note: bytes | None = None  #: for all chunks


def answer(asked: DataFrame, reply: Callable[[list[bytes]], Reply]) -> DataFrame:
    """The replies of all buckets; each sees all payloads sent to it."""

    def run(table: pa.Table) -> pa.Table:
        bucket, out = table.column("bucket")[0].as_py(), reply(table.column("payload").to_pylist())
        rows = [(bucket, c, p) for c, p in zip(table.column("chunk").to_pylist(), out.payloads, strict=True)]
        if out.note is not None:
            rows.append((bucket, NOTE, out.note))
        return pa.Table.from_batches([parcels(rows, out.stats)])

    return asked.select("bucket", "chunk", "payload").groupBy("bucket").applyInArrow(run, PARCEL)


def bring(chunks: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """The chunks with the answers to them as ``column``, a list of (bucket, payload) by bucket."""
    mine = answers.where(F.col("chunk") != NOTE).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "payload"))).alias(column))
    return chunks.join(mine, "chunk", "left")
