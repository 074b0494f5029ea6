"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of ASCII letters, digits and non-ASCII characters, lower-cased (A-Z). Each mask of
``MASKS`` picks five positions of a window and ignores the others; the hash of the picked tokens is
the join key between benchmark items and documents. The masks are chosen so that two aligned
stretches of 8 to 13 tokens in which at least four fifths agree have a common window under some
mask, wherever the substitutions stand. Around each hit the two token sequences are laid side by
side, and the document is contaminated by the item if in some stretch of ``WINDOW`` tokens (the
whole item, if it is shorter) at least ``AGREE`` of them agree.

Items of fewer than eight tokens cannot hold the masks under substitutions; they are found whole and
unchanged, by a mask of all their tokens. Items without a token are never found.

Most windows of the corpus hit nothing. A table of one bit for each value of the hashes' first
``FILTER_BITS`` bits, of fixed size whatever the benchmark's is, keeps them from the shuffle; what
passes is joined on the whole hash, so nothing depends on the filter but time.

Null or empty texts: no tokens, clean. Null doc_id or item_id: reported as null. Repeated rows of one
doc_id and text are one document in the report; rows of one doc_id with different texts are told
apart by the text's hash. Empty tables: no hits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.llm.arrays import LOWER, find_words, mix, small_batches, text_bytes, unused, word_array, word_ids

# The smallest set found of five positions in at most eight that meets the rule above.
MASKS = [(0, 1, 2, 5, 7), (0, 2, 3, 4, 5), (0, 2, 4, 6, 7)]
SPAN = 8
WINDOW = 13
AGREE = 0.8
FILTER_BITS = 26

PARTS = np.ones(256, bool)
PARTS[128:] = PARTS[48:58] = PARTS[65:91] = PARTS[97:123] = False

SEEDS = "seed long, id long, tie long, tokens array<long>, left int, size int"


def needed(tokens: int) -> int:
    """How many tokens of a stretch must agree."""
    return -(-int(AGREE * 100) * tokens // 100)


def token_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token of a batch, and where each text's tokens begin."""
    data, offsets = text_bytes(text)
    data = LOWER[data]
    start, end, doc, inside = find_words(data, offsets, PARTS)
    ids, distinct = word_ids(word_array(data, inside, start, end))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
    return hashes[ids], np.searchsorted(doc, np.arange(len(offsets)))


def seeds(tokens: np.ndarray, masks: list[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """For each mask, the hash of every window of the sequence."""
    for k, mask in enumerate(masks):
        n = max(len(tokens) - mask[-1], 0)
        out = np.full(n, k + 1 + (len(mask) << 8), np.uint64)
        for i, p in enumerate(mask):
            out += tokens[p : p + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * (i + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        yield mask, mix(out)


def _rows(ids: np.ndarray, ties: np.ndarray, tokens: np.ndarray, where: np.ndarray, at: np.ndarray, seed: np.ndarray, masks: list[tuple[int, ...]]) -> pa.RecordBatch:
    """Hits with the tokens around them, as far as a stretch that holds the seed can reach."""
    owner = np.searchsorted(where, at, side="right") - 1
    spans = np.array([m[-1] + 1 for m in masks])
    low = np.maximum(at - WINDOW + 1, where[owner])
    high = np.minimum(at + spans + WINDOW - 1, where[owner + 1])
    sizes = high - low
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = tokens[np.repeat(low - ends[:-1], sizes) + np.arange(ends[-1])].view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
    size = (where[1:] - where[:-1])[owner]
    id_column = ids.take(pa.array(owner))
    return pa.RecordBatch.from_arrays(
        [pa.array(seed.view(np.int64)), id_column, pa.array(ties[owner]), lists, pa.array((at - low).astype(np.int32)), pa.array(size.astype(np.int32))],
        ["seed", "id", "tie", "tokens", "left", "size"],
    )


def _item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 256 << 10):
        tokens, where = token_hashes(batch.column(1))
        sizes = np.diff(where)
        for mask, seed in seeds(tokens, [*MASKS, *(tuple(range(n)) for n in range(1, SPAN))]):
            whole = len(mask) == mask[-1] + 1  # all tokens of a short item
            at = np.arange(len(seed))
            owner = np.searchsorted(where, at, side="right") - 1
            fits = (sizes[owner] == len(mask)) & (at == where[owner]) if whole else at + mask[-1] < where[owner + 1]
            at = at[fits & ((sizes[owner] < SPAN) == whole)]
            if len(at):
                yield _rows(batch.column(0), np.zeros(batch.num_rows, np.int64), tokens, where, at, seed[at], [mask] * len(at))


def _agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        best = []
        for ours, left, theirs, at, size in zip(rows["tokens"], rows["left"], rows["item_tokens"], rows["item_left"], rows["item_size"], strict=True):
            back, ahead = min(left, at), min(len(ours) - left, len(theirs) - at)
            same = np.cumsum([0, *(x == y for x, y in zip(ours[left - back : left + ahead], theirs[at - back : at + ahead], strict=True))])
            width = min(WINDOW, size)
            best.append(int((same[width:] - same[:-width]).max()) if len(same) > width else 0)
        keep = pa.array([b >= (needed(min(WINDOW, n)) if n >= SPAN else n) for b, n in zip(best, rows["item_size"], strict=True)])
        out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), batch.column("item_id"), pa.array(best, pa.int32())], ["doc_id", "tie", "item_id", "agreeing"])
        yield out.filter(keep)


def _filter_table(item_seeds: DataFrame) -> np.ndarray:
    """Bits of the first FILTER_BITS bits of the items' hashes; 2 ** FILTER_BITS bits at most reach the driver."""
    head = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = item_seeds.select(F.shiftright(head, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))").alias("bit"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[word] = bits
    return table.view(np.uint64)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document and item that overlap: doc_id, tie (hash of the text), item_id, agreeing (tokens of the best stretch)."""
    spark: SparkSession = docs.sparkSession
    items = benchmark.selectExpr("cast(item_id as long) as id", "text").mapInArrow(_item_seeds, SEEDS)
    small = sorted(r[0] for r in items.where(f"size < {SPAN}").select("size").distinct().collect())  # seven values at most
    masks = [*MASKS, *(tuple(range(n)) for n in range(1, SPAN))]
    table = spark.sparkContext.broadcast(_filter_table(items))

    def doc_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tokens, where = token_hashes(batch.column(2))
            ties = np.asarray(batch.column(1))
            for mask, seed in seeds(tokens, masks):
                if len(mask) == mask[-1] + 1 and len(mask) not in small:
                    continue
                head = seed >> np.uint64(64 - FILTER_BITS)
                at = np.flatnonzero(table.value[head >> np.uint64(6)] >> (head & np.uint64(63)) & np.uint64(1))
                at = at[at + mask[-1] < where[np.searchsorted(where, at, side="right")]]
                if len(at):
                    yield _rows(batch.column(0), ties, tokens, where, at, seed[at], [mask] * len(at))

    rows = docs.selectExpr("cast(doc_id as long) as id", "xxhash64(text) as tie", "text")
    found = rows.mapInArrow(doc_seeds, SEEDS)
    theirs = items.select("seed", F.col("id").alias("item_id"), F.col("tokens").alias("item_tokens"), F.col("left").alias("item_left"), F.col("size").alias("item_size"))
    # A merge join keeps the two Python steps in different stages: one worker for each core, not two.
    pairs = found.join(theirs.hint("merge"), "seed").select("id", "tie", "tokens", "left", "item_id", "item_tokens", "item_left", "item_size")
    hits = pairs.mapInArrow(_agree, "doc_id long, tie long, item_id long, agreeing int")
    return hits.groupBy("doc_id", "tie", "item_id").agg(F.max("agreeing").alias("agreeing"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, all columns."""
    a, b = (unused(docs, n) for n in ("found_id", "found_tie"))
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(a), F.col("tie").alias(b)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"]) == F.col(b))
    return docs.join(found, same, "left_anti")
