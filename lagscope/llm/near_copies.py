"""Near copies by the Jaccard similarity of their sets of 5-word shingles: 0.8 or more links two texts.

A text is lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; its set holds the XXH64 (seed 42)
of every five words in a row, or of all its words if there are fewer. Classes are what is linked through
any chain.

Search. Texts of equal sets are one row from the start. Each set gets 112 least values under as many hash
functions: 28 bands of four, and one byte of each. Sets that share a band and at least 66 of the 112 bytes
are put in one family, through any chain, and within a family every pair is compared by the whole sets. A
pair at exactly 0.8 shares no band with probability 0.5904 ** 28 = 4e-7, and has under 66 equal bytes with
a probability of about 1e-7; both fall quickly above 0.8. So a pair is missed about once in two million,
less often if a chain joins it, and no pair under 0.8 is ever linked. ``SIZE_TILE`` and ``BAND_TILE`` cut
large families and bands into pairs of parts, so no task holds a whole one, and all pairs are still compared.

Null and wordless texts have an empty set and are one class. What is done with null and repeated
doc_ids is as in ``simhash_dedup``. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.llm.arrays import LOWER, find_words, mix, small_batches, text_bytes
from lagscope.llm.components import components
from lagscope.llm.simhash_dedup import _forest, keep
from lagscope.session import store

SHINGLE = 5
SEED = 42
BANDS, ROWS = 28, 4
#: Equal bytes of the sketch that a pair needs to be compared.
LEAST_EQUAL = 66
#: Members of a part of a band; shingles of a part of a family, where a set counts as LEAST_SIZE at least.
BAND_TILE, SIZE_TILE, LEAST_SIZE = 512, 1 << 17, 512

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a batch of texts, one after the other and each in order, and where each begins."""
    data, offsets = text_bytes(text)
    docs = len(offsets) - 1
    data = LOWER[data]
    start, end, doc, inside = find_words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    # Words joined by one space each, so that a shingle is one slice.
    at = np.concatenate(([0], np.cumsum(end - start + 1)))
    joined = np.full(int(at[-1]), 32, np.uint8)
    kept = np.ones(len(joined), bool)
    kept[at[1:] - 1] = False
    joined[kept] = data[inside]
    n = np.bincount(doc, minlength=docs)
    first = np.concatenate(([0], np.cumsum(n)))[doc]
    place = np.arange(len(doc)) - first
    begins = np.flatnonzero((place <= n[doc] - SHINGLE) | (place == 0))
    last = np.minimum(begins + SHINGLE - 1, first[begins] + n[doc[begins]] - 1)
    blob, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(blob[a:b], SEED) for a, b in zip(at[begins].tolist(), (at[last + 1] - 1).tolist(), strict=True)), np.uint64, len(begins))
    owner = doc[begins]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
    return hashes[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=docs))))


def sketches(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set that is not empty: a key of the whole set, its bands, and a byte of each least value."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    if not len(heads):
        return np.zeros(0, np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS * ROWS), np.uint8)
    least = np.stack([np.minimum.reduceat((values ^ x) * t, heads) for x, t in zip(_XOR, _TIMES, strict=True)], axis=1)
    bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(heads), 1))
    for r in range(ROWS):
        bands = mix(bands ^ least[:, r::ROWS])
    return mix(np.add.reduceat(mix(values), heads)), bands, (mix(least) >> np.uint64(56)).astype(np.uint8)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        values, offsets = shingles(batch.column(2))
        some = np.diff(offsets) > 0
        key, bands, equal = sketches(values, offsets)
        keys = np.zeros(batch.num_rows, np.uint64)
        keys[some] = key
        packed = np.concatenate((bands.view(np.uint8).reshape(len(key), BANDS * 8), equal), axis=1)
        found = iter(packed)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys.view(np.int64)), pa.array(np.diff(offsets)), pa.array([next(found).tobytes() if s else None for s in some], pa.binary())],
            ["doc_id", "tie", "key", "size", "sketch"],
        )


def _to_bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            bands = np.stack([np.frombuffer(s, np.int64, BANDS) for s in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(bands.reshape(-1)), pa.array(np.repeat(np.asarray(part.column(0)), BANDS))], ["band", "key"])


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that arrive in order of their first column, in batches that hold every group whole."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.asarray(batch.column(0))
        whole = int(np.searchsorted(group, group[-1]))
        if waiting and (whole or group[0] != waiting[-1].column(0)[0].as_py()):
            yield pa.concat_batches([*waiting, batch.slice(0, whole)])
            waiting = []
        elif whole:
            yield batch.slice(0, whole)
        waiting.append(batch.slice(whole))
    if waiting:
        yield pa.concat_batches(waiting)


def _bounds(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where groups of two rows or more begin and end."""
    cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
    for k in np.flatnonzero(np.diff(cuts) > 1):
        yield int(cuts[k]), int(cuts[k + 1])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of bands of two or more, dealt to the pairs of parts of their band."""
    for batch in _groups(batches):
        band, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        tiles, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _bounds(band):
            parts = -(-(b - a) // BAND_TILE)
            for i in range(parts):
                mine = key[a + i * BAND_TILE : min(b, a + (i + 1) * BAND_TILE)]
                for j in range(parts):
                    tile = mix(band[a : a + 1].view(np.uint64) + np.uint64(min(i, j) << 32 | max(i, j))).view(np.int64)[0]
                    if i != j or parts == 1:  # a pair within a part is in every tile of the part
                        tiles.append(np.full(len(mine), tile))
                        members.append(mine)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(members))], ["tile", "key"])


def _joined(near: Callable[[list[bytes]], Iterator[tuple[int, np.ndarray]]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows of (tile, key, bytes): a forest of the links that ``near`` finds in each tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            key = np.asarray(batch.column(1))
            x, y, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for a, b in _bounds(np.asarray(batch.column(0))):
                for i, others in near(batch.column(2).slice(a, b - a).to_pylist()):
                    x.append(np.full(len(others), key[a + i]))
                    y.append(key[a + others])
                    waiting += len(others)
                    if waiting > 1 << 18:
                        low = _forest(np.concatenate(x), np.concatenate(y))
                        x, y, waiting = [low[0]], [low[1]], 0
            p, q = _forest(np.concatenate(x), np.concatenate(y))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return run


def alike(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Each sketch's number, and those of later sketches with enough equal bytes."""
    bytes_ = np.stack([np.frombuffer(s, np.uint8, BANDS * ROWS, BANDS * 8) for s in rows])
    for i in range(len(rows) - 1):
        found = np.flatnonzero(np.count_nonzero(bytes_[i + 1 :] == bytes_[i], axis=1) >= LEAST_EQUAL)
        if len(found):
            yield i, found + i + 1


def similar(rows: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's number, and those of later sets with a Jaccard similarity of at least 0.8."""
    sets = [np.frombuffer(s, np.uint64) for s in rows]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    size = np.diff(offsets)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(values), np.int64)
    for i in range(len(sets) - 1):
        marked[where[offsets[i] : offsets[i + 1]]] = 1
        both = np.add.reduceat(marked[where[offsets[i + 1] :]], offsets[i + 1 : -1] - offsets[i + 1])
        marked[where[offsets[i] : offsets[i + 1]]] = 0
        found = np.flatnonzero(9 * both >= 4 * (size[i] + size[i + 1 :]))
        if len(found):
            yield i, found + i + 1


def _to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        values, offsets = shingles(batch.column(1))
        blob, at = values.tobytes(), (8 * offsets).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blob[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["key", "members"])


def _in_order(tiles: DataFrame) -> DataFrame:
    return tiles.repartition("tile").sortWithinPartitions("tile")


def _links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between keys of ``sets`` (key, first, size, sketch) that join what is similar."""
    some = sets.where("sketch is not null").select("key", "sketch")
    bands = some.mapInArrow(_to_bands, "band long, key long").repartition("band").sortWithinPartitions("band")
    shared = bands.mapInArrow(_shared, "tile long, key long")
    maybe = _in_order(shared.join(some, "key").select("tile", "key", "sketch")).mapInArrow(_joined(alike), "a long, b long")
    roots = components(maybe, "near-families")
    member = roots.select(F.col("node").alias("key"), F.col("root").alias("family")).unionAll(roots.select("root", "root").distinct())
    member = store(member.join(sets.select("key", "first", "size"), "key"), "near-members")
    parts = member.groupBy("family").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST_SIZE))) / SIZE_TILE).alias("parts"))
    part = F.pmod(F.xxhash64("key", "family"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = member.join(parts, "family").select("key", "family", "parts", part.alias("part"), other).where("part <> other or parts = 1")
    dealt = dealt.select("key", F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")).alias("tile"))
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"), "text")
    same = F.col("id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    texts = named.join(member.select("key", "first"), same).select("key", "text")
    # A set's first row can be there twice.
    whole = texts.mapInArrow(_to_sets, "key long, members binary").groupBy("key").agg(F.first("members").alias("members"))
    tiles = dealt.join(whole, "key").select("tile", "key", "members")
    return _in_order(tiles).mapInArrow(_joined(similar), "a long, b long")


def one_near_copy(docs: DataFrame) -> DataFrame:
    """One document of each class, all columns: the smallest doc_id, then the smallest hash of the text."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    rows = store(keys.mapInArrow(_sketch, "doc_id long, tie long, key long, size long, sketch binary"), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("first")
    sets = store(rows.groupBy("key").agg(first, F.first("size").alias("size"), F.first("sketch").alias("sketch")), "near-sets")
    roots = components(_links(docs, sets), "near-links").withColumnRenamed("node", "key")
    best = sets.select("key", "first").join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    return keep(docs, rows, best)
