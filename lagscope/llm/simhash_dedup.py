"""Near-duplicates by SimHash fingerprints, found with tables of distances to reference fingerprints.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and 3-word shingles with repeats;
bit i of its fingerprint is set if bit i of over half of the shingles' XXH64 (seed 42) is. Texts
link where fingerprints differ in at most two bits; classes are what is linked through any chain.

Search. ``references`` makes fixed fingerprints ("pivots"): a base, and for each of eleven segments
of bits, some that differ from the base in that segment only. The table of Hamming distances from
a fingerprint to all of them is its coordinates. Taking a segment's distances less the base's leaves
what the segment adds, and the chosen pivots tell all its values apart. Two bits can touch at most
two segments, so two linked fingerprints agree in the coordinates of at least nine of eleven: each
fingerprint is sent to 55 blocks, one for each pair of segments left out. Members of a block differ
in twelve bits at most, so a block has at most 4096 of them whatever the input is: no block needs
to be cut. Pairs whose largest coordinate difference exceeds two are discarded, the others verified
bit by bit, and each task sends on only a spanning forest of what it found.

Copies are first combined to distinct fingerprints, so hot groups are one row before any pairing.

Null or wordless texts have fingerprint zero and link like others. A null doc_id gets the class of
its fingerprint; a class of nulls only has a null id. Repeated rows each get their row. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.llm.arrays import LOWER, find_words, mix, small_batches, text_bytes, unused
from lagscope.llm.components import components
from lagscope.session import store

BITS = 2
SHINGLE = 3
SEED = 42
SEGMENTS = [(6 * i, 6) for i in range(9)] + [(54, 5), (59, 5)]
PER_SEGMENT = 7


def references() -> tuple[np.ndarray, list[slice]]:
    """The reference fingerprints, the base first, and the place of each segment's own."""
    rng = np.random.default_rng(SEED)
    base = int(rng.integers(0, 1 << 63))
    out, where = [base], []
    for shift, width in SEGMENTS:
        values = np.arange(1 << width)
        while True:
            flips = rng.choice(np.arange(1, 1 << width), PER_SEGMENT, replace=False)
            table = np.bitwise_count(values[:, None] ^ flips[None, :]).astype(np.int64) - np.bitwise_count(values)[:, None]
            if len(np.unique(table, axis=0)) == len(values):  # tells all values of the segment apart
                break
        where.append(slice(len(out), len(out) + PER_SEGMENT))
        out += [base ^ (int(f) << shift) for f in flips]
    return np.array(out, dtype=np.uint64), where


REFERENCES, PLACES = references()


def distances(prints: np.ndarray) -> np.ndarray:
    """The distance table: one row for each fingerprint, one column for each reference."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def block_keys(table: np.ndarray) -> np.ndarray:
    """Keys of the blocks of each fingerprint, one column for each pair of segments left out."""
    powers = 15 ** np.arange(PER_SEGMENT, dtype=np.int64)
    own = table - table[:, :1]
    codes = np.stack([mix(((own[:, p].astype(np.int64) + 7) @ powers).astype(np.uint64) + np.uint64((s + 1) << 40)) for s, p in enumerate(PLACES)], axis=1)
    whole = codes.sum(axis=1, dtype=np.uint64)
    return np.stack([mix(whole - codes[:, i] - codes[:, j] + np.uint64(i << 8 | j)) for i, j in combinations(range(len(SEGMENTS)), 2)], axis=1)


def fingerprints(text: pa.Array) -> np.ndarray:
    """Fingerprints of a batch of texts."""
    data, offsets = text_bytes(text)
    docs = len(offsets) - 1
    data = LOWER[data]
    start, end, doc, inside = find_words(data, offsets)
    out = np.zeros(docs, np.uint64)
    if not len(start):
        return out
    # Words joined by one space each, so that a shingle is one slice.
    sizes = end - start + 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    joined = np.full(int(at[-1]), 32, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[at[1:] - 1] = False
    joined[keep] = data[inside]
    n = np.bincount(doc, minlength=docs)
    first = np.concatenate(([0], np.cumsum(n)))[doc]
    place = np.arange(len(doc)) - first
    begins = np.flatnonzero((place <= n[doc] - SHINGLE) | (place == 0))
    last = np.minimum(begins + SHINGLE - 1, first[begins] + n[doc[begins]] - 1)
    blob, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(blob[a:b], SEED) for a, b in zip(at[begins].tolist(), (at[last + 1] - 1).tolist(), strict=True)), np.uint64, len(begins))
    owner = doc[begins]
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    counts = np.concatenate((np.diff(heads), [len(owner) - heads[-1]]))
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    out[owner[heads]] = np.packbits(2 * sums > counts[:, None], axis=1).view(">u8").reshape(-1)
    return out


def _fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], ["doc_id", "print"])


def _to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            prints = np.asarray(batch.column(0).slice(at, 4096)).view(np.uint64)
            keys = block_keys(distances(prints))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(prints, keys.shape[1]).view(np.int64))], ["block", "print"]
            )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links that join what the given links join: every value to the smallest it reaches."""
    values, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(values))
    return values[other], values[label[other]]


def links(block: np.ndarray, prints: np.ndarray, bits: int = BITS, held: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal ``block``, given in order of block: a spanning forest of them."""
    table = distances(prints)
    out_a, out_b, waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
    alive, step = np.arange(len(block)), 1
    while True:
        alive = alive[alive + step < len(block)]
        alive = alive[block[alive] == block[alive + step]]
        if not len(alive):
            break
        for at in range(0, len(alive), 1 << 16):
            i = alive[at : at + (1 << 16)]
            j = i + step
            near = np.abs(table[i] - table[j]).max(axis=1) <= bits
            i, j = i[near], j[near]
            true = (np.bitwise_count(prints[i] ^ prints[j]) <= bits) & (prints[i] != prints[j])
            out_a.append(prints[i[true]])
            out_b.append(prints[j[true]])
            waiting += int(true.sum())
        if waiting > held:
            a, b = _forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, waiting = [a], [b], 0
        step += 1
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


def _in_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order of block; the last block of a batch waits for the next batch."""
    block, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def emit(b: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        same = np.zeros(len(b), bool)
        same[1:] = b[1:] == b[:-1]
        same[:-1] |= same[1:].copy()
        x, y = links(b[same], p[same])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    for batch in batches:
        block = np.concatenate((block, np.asarray(batch.column(0))))
        prints = np.concatenate((prints, np.asarray(batch.column(1)).view(np.uint64)))
        if len(block):
            whole = int(np.searchsorted(block, block[-1]))
            if whole:
                yield emit(block[:whole], prints[:whole])
                block, prints = block[whole:], prints[whole:]
    if len(block):
        yield emit(block, prints)


def _classes(rows: DataFrame) -> DataFrame:
    """Of rows of (doc_id, print): each print and the smallest doc_id of its class."""
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    blocks = distinct.select("print").mapInArrow(_to_blocks, "block long, print long")
    found = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_in_blocks, "a long, b long")
    roots = components(found, "simhash-links")
    member = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return member.join(lowest, "root").select("print", "root", "component_id")


def simhash_classes(docs: DataFrame) -> DataFrame:
    """Fingerprint and class of every row: doc_id, fingerprint (hex), component_id."""
    rows = store(docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_fingerprint, "doc_id long, print long"), "simhash-prints")
    known = _classes(rows).drop("root")
    return rows.join(known, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, all columns: the smallest doc_id, then the smallest hash of the text.

    Rows of one doc_id and text are one document; one of them stays.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fingerprints(batch.column(2)).view(np.int64))], ["doc_id", "tie", "print"])

    rows = store(keys.mapInArrow(run, "doc_id long, tie long, print long"), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("first")
    of_print = rows.groupBy("print").agg(first)
    return keep(docs, rows, of_print.join(_classes(rows).select("print", "root"), "print").groupBy("root").agg(F.min("first").alias("first")))


def keep(docs: DataFrame, rows: DataFrame, best: DataFrame) -> DataFrame:
    """The documents that ``best`` names in ``first`` (doc_id, tie), each once; ``rows`` has doc_id and tie of all."""
    stay = best.select(F.col("first.doc_id").alias("id"), F.col("first.tie").alias("tie"))
    left = _with_key(docs, stay, "left_semi")
    # Repeated rows are rare, so they are looked for in the keys, and only they are numbered.
    again = store(rows.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), "tie"), "simhash-again")
    if again.isEmpty():
        return left
    return _with_key(left, again, "left_anti").unionByName(_with_key(left, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def _with_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with (id, tie), whatever the documents' columns are called."""
    a, b = (unused(docs, n) for n in ("id", "tie"))
    named = keys.select(F.col("id").alias(a), F.col("tie").alias(b))
    return docs.join(named, docs["doc_id"].cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"]) == F.col(b)), how)
