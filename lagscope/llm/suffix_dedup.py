"""Removal of repeated passages: every byte inside a string of ``LENGTH`` bytes that also starts earlier.

Texts are UTF-8 bytes; a null text is empty; strings never cross documents; earlier means a smaller
(doc_id, start). Strings ("windows") are judged on the input. The work is cut so that windows that may be equal
meet in one task, and only they:

1. Documents are packed into chunks. Every window has one anchor: the smallest hash among its
   ``GRAM``-byte grams, the last of equals. Windows in a row with one anchor form a stretch. Equal
   windows have equal anchors at equal places, whatever stands around them.
2. Stretches with equal bytes are compared by hash: all but the earliest are repeated as a
   whole. Chunks first combine their own, so copies of one text cost one row for each chunk.
3. Where one anchor still has several different stretches, their windows may be equal in part. Their
   bytes go to the bucket of the anchor, where a suffix array of them is built by two-stage sorting.
   Neighbours in it with a common prefix of ``LENGTH`` bytes are equal windows, and all but the
   earliest of them are repeated.
4. Answers come back to the chunks, which mark the bytes and report each document.

A few anchors (inside a passage that very many documents share, near its end) may have very many
different stretches. Anchors with more than ``HOT`` of them, and more than a share of 1 / ``HOT_SHARES`` of all
stretches, are listed first (a list of at most ``HOT_SHARES`` entries), and their windows are compared one
by one, by hash, in buckets of the window's hash. So no bucket depends on one anchor.

Null doc_id: before all others. Rows with equal doc_id are ordered by the hash of their texts; rows
with equal doc_id and text are one document that occurs twice, and none of them counts as the
earlier. Texts of any length are cut into segments at fixed places and compared whole. Empty tables: no
rows. Other columns are kept by ``deduplicated``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagscope.llm.arrays import mix, pack, pack_sorted, small_batches, text_bytes, unpack, unpack_sorted
from lagscope.llm.exchange import Reply, answer, ask, bring, write_chunks
from lagscope.llm.suffix_array import same_as_before, sort_suffixes
from lagscope.session import store

LENGTH = 100
GRAM = 32
CHUNK = 8 << 20
PIECE = 1 << 20
SEGMENT = 1 << 20
BLOCK = 1 << 20
HOT = 20_000
HOT_SHARES = 50_000
HOT_LOCAL = 8

FIRST, REPEATED, OPEN = 0, 1, 2
NO_ID = -(1 << 63)

_BYTE_CODES = mix(np.arange(1, 257))
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place, by doubling its length."""
    h, n = _BYTE_CODES[data], 1
    while n < GRAM:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
        n *= 2
    return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[: len(keys) - (width - n)], keys[width - n :]) if n < width else keys


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Byte ranges (from, to) to look at together, and before which place windows start: whole documents or a segment of one."""
    begin = at = 0
    for d in range(len(offsets) - 1):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        if hi - lo > SEGMENT:
            if begin < lo:
                yield begin, lo, lo
            for at in range(lo, hi, SEGMENT):
                yield at, min(at + SEGMENT + LENGTH - 1, hi), min(at + SEGMENT, hi)
            begin = hi
        elif hi - begin > PIECE and begin < lo:
            yield begin, lo, lo
            begin = lo
    if begin < int(offsets[-1]):
        yield begin, int(offsets[-1]), int(offsets[-1])


class Stretches:
    """Stretches of a chunk: first and last window start, anchor, hash of the bytes, document, and where they are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        parts = [self._of(data, offsets, *p) for p in _pieces(offsets)]
        parts = [p for p in parts if len(p[0])]
        kinds = (np.int64, np.int64, np.uint64, np.uint64)
        self.start, self.end, self.anchor, self.content = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1

    @staticmethod
    def _of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, before: int) -> tuple[np.ndarray, ...]:
        part = data[lo:hi]
        if len(part) < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        grams = gram_hashes(part)
        key = grams ^ (grams >> np.uint64(29))
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key |= _PLACE
        key -= np.arange(len(key), dtype=np.uint64)  # of equals, the last is least
        least = sliding_least(key, LENGTH - GRAM + 1)
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        cut = np.zeros(len(least) + 1, bool)  # a stretch ends before here
        cut[0] = cut[-1] = True
        cut[1:-1] = least[1:] != least[:-1]
        cut[inner[inner < len(least)]] = True
        change = np.zeros(len(least) + 1, np.int32)
        np.add.at(change, np.clip(inner - LENGTH + 1, 0, len(least)), 1)
        np.subtract.at(change, np.clip(inner, 0, len(least)), 1)
        crossing = np.cumsum(change[:-1]) > 0
        crossing[before - lo :] = True
        edge = np.flatnonzero(crossing[1:] != crossing[:-1]) + 1
        cut[edge] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(least)) - 1
        keep = ~crossing[start]
        start, end = start[keep], end[keep]
        anchor = grams[(_PLACE - (least[start] & _PLACE)).astype(np.int64)]
        blob, digest = part.tobytes(), xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(blob[a:b]) for a, b in zip(start.tolist(), (end + LENGTH).tolist(), strict=True)), np.uint64, len(start))
        return start + lo, end + lo, anchor, content


class Chunk:
    """A packed chunk, its stretches, and the earliest of equal ones within it."""

    def __init__(self, packed: bytes):
        self.ids, self.ties, self.offsets, raw = unpack(packed)
        self.data = np.frombuffer(raw, np.uint8)
        s = self.stretches = Stretches(self.data, self.offsets)
        self.place = s.start - self.offsets[s.doc]
        order = np.lexsort((self.place, self.ties[s.doc], self.ids[s.doc], s.content, s.anchor))
        new = _changes(s.anchor[order], s.content[order])
        #: Stretches that speak for themselves; the others are as the one of ``speaker`` or repeat it.
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.speakers = order[head]
        first = np.empty(len(order), np.int64)
        first[order] = self.speakers[group]
        self.speaker_of = first
        self.same_document = (self.ids[s.doc] == self.ids[s.doc[first]]) & (self.ties[s.doc] == self.ties[s.doc[first]]) & (self.place == self.place[first])

    def split(self, which: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """The given stretches by the bucket of their anchor, each part in order of anchor and content."""
        s = self.stretches
        bucket = (mix(s.anchor[which]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((s.content[which], s.anchor[which], bucket))
        which, bucket = which[order], bucket[order]
        for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(part):
                yield int(bucket[part[0]]), which[part]

    def keys(self, which: np.ndarray) -> list[np.ndarray]:
        """What orders the given stretches: ids and ties of their documents, each document's number, places."""
        docs, number = np.unique(self.stretches.doc[which], return_inverse=True)
        return [self.ids[docs], self.ties[docs], number.astype(np.uint32), self.place[which].astype(np.uint32 if len(self.data) < 1 << 32 else np.uint64)]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _ordered(ids: np.ndarray, ties: np.ndarray, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids[number], ties[number].astype(np.int64), place.astype(np.int64)


def _repeats(order: np.ndarray, new: np.ndarray, *when: np.ndarray) -> np.ndarray:
    """In groups of ``order`` that begin at ``new``, sorted by ``when`` inside: which are later than the first."""
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order] = np.logical_or.reduce([w[order] != w[first] for w in when])
    return out


def compare_stretches(payloads: list[bytes]) -> Reply:
    """Of each stretch: the first or only one of its kind, repeated, or open to comparison within its anchor."""
    anchors, contents, whens = [], [], []
    for p in payloads:
        steps, content, *key = unpack(p)
        anchors.append(unpack_sorted(steps))
        contents.append(content)
        whens.append(_ordered(*key))
    sizes = [len(a) for a in anchors]
    anchor, content = np.concatenate(anchors), np.concatenate(contents)
    ids, ties, place = (np.concatenate([w[i] for w in whens]) for i in range(3))
    order = np.lexsort((place, ties, ids, content, anchor))
    new = _changes(anchor[order], content[order])
    state = np.where(_repeats(order, new, ids, ties, place), REPEATED, FIRST).astype(np.uint8)
    heads = order[np.flatnonzero(new)]
    many = np.bincount(np.cumsum(_changes(anchor[heads])) - 1)
    several = np.repeat(many > 1, many)
    open_groups = several[np.cumsum(new) - 1]
    at = order[open_groups]
    state[at] = np.where(state[at] == FIRST, OPEN, state[at])
    return Reply([pack(part) for part in np.split(state, np.cumsum(sizes)[:-1])])


def repeated_windows(strings: list[bytes], windows: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """For each string, which of its first windows equals a window of a string of lower rank."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    text = np.zeros(int(sizes.sum()), np.uint16)
    starts = np.cumsum(sizes) - sizes
    filled = np.ones(len(text), bool)
    filled[starts + sizes - 1] = False
    text[filled] = np.frombuffer(b"".join(strings), np.uint8)
    text[filled] += 1
    ends = np.repeat(starts + sizes - 1, sizes)
    owner = np.repeat(np.arange(len(strings)), sizes)
    wanted = np.arange(len(text)) - starts[owner] < windows[owner]
    order = sort_suffixes(text, ends, wanted, LENGTH)
    same = same_as_before(text, order, LENGTH)
    group = np.cumsum(~same) - 1
    ranks = rank[owner[order]]
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ranks)
    out = np.zeros(len(text), bool)
    out[order] = ranks > least[group]
    return [out[a : a + n] for a, n in zip(starts.tolist(), windows.tolist(), strict=True)]


def compare_windows(payloads: list[bytes]) -> Reply:
    """Which windows of each open stretch are repeated, by suffix arrays over stretches of one anchor."""
    anchors, strings, windows, whens = [], [], [], []
    for p in payloads:
        steps, n, raw, *key = unpack(p)
        anchors.append(unpack_sorted(steps))
        windows.append(n.astype(np.int64))
        ends = np.cumsum(windows[-1] + LENGTH - 1)
        strings += [raw[a:b] for a, b in zip((ends - windows[-1] - LENGTH + 1).tolist(), ends.tolist(), strict=True)]
        whens.append(_ordered(*key))
    sizes = [len(a) for a in anchors]
    anchor, n = np.concatenate(anchors), np.concatenate(windows)
    ids, ties, place = (np.concatenate([w[i] for w in whens]) for i in range(3))
    when = np.lexsort((place, ties, ids))
    rank = np.empty(len(when), np.int64)
    rank[when] = np.cumsum(_changes(ids[when], ties[when], place[when]))
    by_anchor = np.argsort(anchor, kind="stable")
    groups = np.append(np.flatnonzero(_changes(anchor[by_anchor])), len(by_anchor))
    ends = np.cumsum(n[by_anchor] + LENGTH)
    found: list[np.ndarray] = [np.zeros(0, bool)] * len(anchor)
    at = 0
    while at < len(groups) - 1:
        base = ends[groups[at] - 1] if groups[at] else 0
        to = max(at + 1, int(np.searchsorted(ends[groups[1:] - 1], base + BLOCK, side="right")))
        block = by_anchor[groups[at] : groups[to]]
        for i, bits in zip(block.tolist(), repeated_windows([strings[i] for i in block.tolist()], n[block], rank[block]), strict=True):
            found[i] = bits
        at = to
    out, begin = [], 0
    for size in sizes:
        bits = np.concatenate([np.zeros(0, bool), *found[begin : begin + size]])
        out.append(pack(np.packbits(bits)))
        begin += size
    return Reply(out)


def compare_hashes(payloads: list[bytes]) -> Reply:
    """Which windows of hot anchors are repeated, by the windows' hashes."""
    low, high, whens = [], [], []
    for p in payloads:
        a, b, *key = unpack(p)
        low.append(a)
        high.append(b)
        whens.append(_ordered(*key))
    sizes = [len(a) for a in low]
    x, y = np.concatenate(low), np.concatenate(high)
    ids, ties, place = (np.concatenate([w[i] for w in whens]) for i in range(3))
    order = np.lexsort((place, ties, ids, x, y))
    bits = _repeats(order, _changes(x[order], y[order]), ids, ties, place)
    return Reply([pack(np.packbits(part)) for part in np.split(bits, np.cumsum(sizes)[:-1])])


class Plan:
    """What each pass needs: numbers of buckets and the hot anchors. The same on all tasks."""

    def __init__(self, buckets: int, hot: np.ndarray):
        self.buckets, self.hot = buckets, hot

    def _is_hot(self, chunk: Chunk, which: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(which), bool)
        at = np.minimum(np.searchsorted(self.hot, chunk.stretches.anchor[which]), len(self.hot) - 1)
        return self.hot[at] == chunk.stretches.anchor[which]

    def ask_stretches(self, packed: bytes) -> Iterator[tuple[int, bytes]]:
        chunk = Chunk(packed)
        for bucket, part in chunk.split(self._cold(chunk), self.buckets):
            s = chunk.stretches
            yield bucket, pack(pack_sorted(s.anchor[part]), s.content[part], *chunk.keys(part))

    def _cold(self, chunk: Chunk) -> np.ndarray:
        return chunk.speakers[~self._is_hot(chunk, chunk.speakers)]

    def _states(self, chunk: Chunk, answers: list) -> np.ndarray:
        state = np.zeros(len(chunk.stretches.start), np.uint8)
        got = {r["bucket"]: r["payload"] for r in answers or []}
        for bucket, part in chunk.split(self._cold(chunk), self.buckets):
            state[part] = unpack(got[bucket])[0]
        return state

    def _open(self, chunk: Chunk, states: list) -> tuple[np.ndarray, np.ndarray]:
        state = self._states(chunk, states)
        return state, chunk.speakers[state[chunk.speakers] == OPEN]

    def ask_windows(self, packed: bytes, states: list) -> Iterator[tuple[int, bytes]]:
        chunk = Chunk(packed)
        _, which = self._open(chunk, states)
        s = chunk.stretches
        blob = chunk.data.tobytes()
        for bucket, part in chunk.split(which, self.buckets):
            raw = b"".join(blob[a:b] for a, b in zip(s.start[part].tolist(), (s.end[part] + LENGTH).tolist(), strict=True))
            yield bucket, pack(pack_sorted(s.anchor[part]), (s.end[part] - s.start[part] + 1).astype(np.uint32), raw, *chunk.keys(part))

    def _hot_windows(self, chunk: Chunk) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each bucket: places and the two halves of the hash of windows of hot anchors."""
        s = chunk.stretches
        which = np.flatnonzero(self._is_hot(chunk, np.arange(len(s.start))))
        if not len(which):
            return
        n = s.end[which] - s.start[which] + 1
        at = np.repeat(s.start[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        blob = chunk.data.tobytes()
        digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(blob[a : a + LENGTH]) for a in at.tolist()), ">u8").reshape(-1, 2).astype(np.uint64)
        bucket = (digest[:, 0] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), at[part], digest[part, 0], digest[part, 1]

    def ask_hashes(self, packed: bytes) -> Iterator[tuple[int, bytes]]:
        chunk = Chunk(packed)
        for bucket, at, high, low in self._hot_windows(chunk):
            doc = np.searchsorted(chunk.offsets, at, side="right") - 1
            docs, number = np.unique(doc, return_inverse=True)
            place = at - chunk.offsets[doc]
            order = np.lexsort((place, chunk.ties[doc], chunk.ids[doc], low, high))
            new = _changes(high[order], low[order])  # equal windows of the chunk: the first speaks
            first = order[np.flatnonzero(new)]
            yield bucket, pack(high[first], low[first], chunk.ids[docs], chunk.ties[docs], number[first].astype(np.uint32), place[first].astype(np.uint64))

    def covered(self, packed: bytes, states: list, windows: list, hashes: list) -> tuple[Chunk, np.ndarray]:
        """The chunk, and which of its bytes are inside a repeated window."""
        chunk = Chunk(packed)
        s = chunk.stretches
        change = np.zeros(len(chunk.data) + 1, np.int32)
        state, which = self._open(chunk, states)
        whole = state[chunk.speaker_of] == REPEATED
        own = np.zeros(len(s.start), bool)
        own[self._cold(chunk)] = True
        cold = own[chunk.speaker_of]
        whole |= cold & ~chunk.same_document
        np.add.at(change, s.start[whole], 1)
        np.subtract.at(change, s.end[whole] + LENGTH, 1)
        got = {r["bucket"]: r["payload"] for r in windows or []}
        twins: dict[int, list[int]] = {}  # the same document in the chunk again
        for i in np.flatnonzero(cold & chunk.same_document & (chunk.speaker_of != np.arange(len(s.start)))).tolist():
            twins.setdefault(int(chunk.speaker_of[i]), []).append(i)
        for bucket, part in chunk.split(which, self.buckets):
            n = s.end[part] - s.start[part] + 1
            bits = np.unpackbits(unpack(got[bucket])[0], count=int(n.sum())).view(bool)
            at = (np.repeat(s.start[part] - np.cumsum(n) + n, n) + np.arange(len(bits)))[bits]
            np.add.at(change, at, 1)
            np.subtract.at(change, at + LENGTH, 1)
            if twins:
                cuts = np.cumsum(n)
                for i, a, b in zip(part.tolist(), (cuts - n).tolist(), cuts.tolist(), strict=True):
                    for twin in twins.get(i, ()):
                        at = s.start[twin] + np.flatnonzero(bits[a:b])
                        np.add.at(change, at, 1)
                        np.subtract.at(change, at + LENGTH, 1)
        got = {r["bucket"]: r["payload"] for r in hashes or []}
        for bucket, at, high, low in self._hot_windows(chunk):
            doc = np.searchsorted(chunk.offsets, at, side="right") - 1
            place = at - chunk.offsets[doc]
            order = np.lexsort((place, chunk.ties[doc], chunk.ids[doc], low, high))
            new = _changes(high[order], low[order])
            later = _repeats(order, new, chunk.ids[doc], chunk.ties[doc], place)
            bits = np.unpackbits(unpack(got[bucket])[0], count=int(new.sum())).view(bool)
            spoken = np.empty(len(at), bool)
            spoken[order] = bits[np.cumsum(new) - 1]
            at = at[later | spoken]
            np.add.at(change, at, 1)
            np.subtract.at(change, at + LENGTH, 1)
        return chunk, np.cumsum(change[:-1], dtype=np.int32) > 0


def _before(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks there are before each place."""
    sums = np.cumsum(marks, dtype=np.int32)
    return np.where(at > 0, sums[np.maximum(at - 1, 0)] if len(sums) else 0, 0).astype(np.int64)


def _pack_documents(batches: Iterable[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunks of documents: number, packed texts, other columns, and locally frequent anchors."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = np.array([NO_ID if v is None else v for v in table.column("_id").to_pylist()], np.int64)
        ties = np.asarray(table.column("_tie"), dtype=np.uint32)
        data, offsets = text_bytes(table.column("_text").combine_chunks())
        packed = pack(ids, ties, offsets, data.tobytes())
        chunk = Chunk(packed)
        anchor, count = np.unique(chunk.stretches.anchor[chunk.speakers], return_counts=True)
        often = count >= HOT_LOCAL
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_table(table.select(rest.schema.names))
        row = {
            "chunk": pa.array([part << 32 | seq], pa.int64()), "docs": pa.array([packed], pa.binary()), "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            "n_bytes": pa.array([len(data)], pa.int64()), "n_stretches": pa.array([len(chunk.speakers)], pa.int64()),
            "often": pa.array([anchor[often].view(np.int64).tolist()], pa.list_(pa.int64())), "times": pa.array([count[often].tolist()], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(row)

    for batch in small_batches(batches, 1 << 20, "_text"):
        rest = batch.select([n for n in batch.schema.names if n not in ("_id", "_tie", "_text")])
        held.append(batch)
        size += batch.column(batch.schema.get_field_index("_text")).nbytes
        if size >= chunk_bytes:
            yield flush()
            held, size, seq = [], 0, seq + 1
    if held:
        yield flush()


PACKED = "chunk long, docs binary, rest binary, n_bytes long, n_stretches long, often array<long>, times array<long>"


def _marked(docs: DataFrame, text_out: bool, chunk_bytes: int, hot: int, hot_shares: int) -> DataFrame:
    """The other columns of each row as ``c0`` and so on, with n_bytes, n_removed, n_spans and the rest as text or hash."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True) if c != "text"]
    columns.append(F.col("text").isNull().alias("text_null"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), (F.xxhash64("text").bitwiseAND((1 << 32) - 1)).alias("_tie"), F.col("text").alias("_text"), *columns)
    chunks = write_chunks(rows.mapInArrow(lambda batches: _pack_documents(batches, chunk_bytes), PACKED), "repeat-chunks")
    n_bytes, stretches = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_stretches"), F.lit(0))).first()
    least = max(hot, stretches // hot_shares)
    often = chunks.select(F.explode(F.arrays_zip("often", "times")).alias("a")).groupBy("a.often").agg(F.sum("a.times").alias("n"))
    anchors = np.sort(np.array([r[0] for r in often.where(F.col("n") >= least).collect()], np.int64).view(np.uint64))
    plan = Plan(max(1, -(-n_bytes // chunk_bytes)), anchors)

    states = store(answer(ask(chunks, lambda docs: plan.ask_stretches(docs), "docs"), compare_stretches), "repeat-states")
    with_states = bring(chunks.select("chunk", "docs", "rest"), states, "states")
    windows = store(answer(ask(with_states, lambda docs, states: plan.ask_windows(docs, states), "docs", "states"), compare_windows), "repeat-windows")
    whole = bring(with_states, windows, "windows")
    if len(anchors):
        hashes = store(answer(ask(chunks, lambda docs: plan.ask_hashes(docs), "docs"), compare_hashes), "repeat-hashes")
        whole = bring(whole, hashes, "hashes")
    else:
        whole = whole.withColumn("hashes", F.lit(None).cast("array<struct<bucket:int,payload:binary>>"))

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, gone = plan.covered(row["docs"], row["states"], row["windows"], row["hashes"])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = chunk.offsets[:-1][chunk.offsets[:-1] < len(gone)]
                begins[heads] = gone[heads]
                removed, spans = (_before(m, chunk.offsets) for m in (gone, begins))
                out: list = []
                for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
                    left = chunk.data[a:b][~gone[a:b]].tobytes()
                    out.append(left.decode(errors="ignore") if text_out else hashlib.sha256(left).hexdigest())
                with pa.ipc.open_stream(row["rest"]) as source:
                    rest = source.read_all().combine_chunks()
                others = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rest.columns]
                arrays = [*others, pa.array(np.diff(chunk.offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [*rest.schema.names, "n_bytes", "n_removed", "n_spans", "left"])

    schema = StructType([f for f in rows.schema.fields if f.name not in ("_id", "_tie", "_text")])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("left", "string")):
        schema = schema.add(name, kind)
    return whole.select("docs", "rest", "states", "windows", "hashes").mapInArrow(report, schema)


def repeated_passages(docs: DataFrame, chunk_bytes: int = CHUNK, hot: int = HOT, hot_shares: int = HOT_SHARES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    out = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), False, chunk_bytes, hot, hot_shares)
    return out.select(F.col("c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("left").alias("kept_sha256"))


def deduplicated(docs: DataFrame, chunk_bytes: int = CHUNK, hot: int = HOT, hot_shares: int = HOT_SHARES) -> DataFrame:
    """All rows and columns, with repeated passages taken out of ``text``; a character cut in two goes as a whole."""
    out = _marked(docs, True, chunk_bytes, hot, hot_shares)
    kept = [(F.when(~F.col("text_null"), F.col("left")) if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*kept)
