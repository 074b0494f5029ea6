"""Token ids of documents in wavelet-matrix files, written in order of doc_id and read back.

Documents are dealt by ranges of doc_id (rows of one id by their text's hash), so that each task
holds a run of the order; it encodes its texts and writes a file whenever about ``shard_tokens`` ids are
together. Files go to the shared folder under names of their own, and a manifest table that Spark
commits names the valid ones: a task that is run again leaves an unlisted file and nothing else.

Texts are encoded by the tokenizers library. A text is cut before single spaces between
non-space characters, where no token of a byte-level vocabulary with this pre-tokenizer can
cross, and the ids of pieces seen before are kept. Texts with an added token are encoded in one.

Null text: the empty text, which has only the end id. Null doc_ids come first and stay null. Repeated
rows are each written. Long texts are encoded whole. Empty table: no files and no rows. Other
columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagscope.llm.arrays import gather, small_batches, text_bytes
from lagscope.llm.files import make_folder, read_whole, write_new
from lagscope.llm.wavelet import Shard, write_shard
from lagscope.session import store, working_dir

END = 2
SHARD_TOKENS = 1 << 20
KEPT = 600_000

_INNER = re.compile(rb"[\s\x1c-\x1f\xc2\xe1-\xe3]")
_MARKS = frozenset(b",.!?;:")
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_LEADS = np.zeros(256, bool)  # first bytes of blank characters of more than one byte
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SECONDS = np.zeros(256, bool)  # their second bytes
_SECONDS[[0x80, 0x81, 0x85, 0x9A, 0xA0]] = True


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self.marks = {m: np.array(self.tokenizer.encode(chr(m), add_special_tokens=False).ids, "<u4").tobytes() for m in _MARKS}
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, parts: set[bytes], special: bool) -> dict[bytes, bytes]:
        """Ids of single parts. Plain words are encoded as one text and told apart by tokens that begin with a space."""
        search = _INNER.search
        words = [p for p in parts if p[0] == 32 and len(p) > 1 and not search(p, 1) and not (special and any(a in p for a in self.added))]
        others = list(parts.difference(words))
        texts = [p.decode() for p in others]
        out = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)}
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            starts = 4 * np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):
                raise ValueError("a word has a token that begins with a space inside it")
            raw = ids.tobytes()
            out.update((p, raw[x:y]) for p, x, y in zip(some, starts.tolist(), [*starts[1:].tolist(), len(raw)], strict=True))
        return out

    def _of(self, parts: list[bytes], special: bool) -> list[bytes]:
        """Ids of distinct parts, by those kept and the tokenizer."""
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}  # what is still in use comes back from the older ones
        kept, know, knew, marks = self.kept, self.kept.get, self.older.get, self.marks
        out: list = []
        waiting: list[tuple[int, bytes, bytes]] = []
        for p in parts:
            ids = know(p)
            if ids is None:
                ids = knew(p)
                if ids is None:
                    stem = p
                    # A mark after a letter is a token of its own, so the word before it may be known.
                    if p[-1] in marks and len(p) > 2 and (p[-2] < 128 and p[-2:-1].isalpha() or p[-2] > 127 and p.decode()[-2].isalpha()):
                        stem = p[:-1]
                        ids = know(stem) or knew(stem)
                    if special and any(a in p for a in self.added):
                        ids, stem = None, p
                    if ids is None:
                        waiting.append((len(out), p, stem))
                        out.append(None)
                        continue
                    ids += marks[p[-1]]
                if len(p) <= 64:
                    kept[p] = ids
            out.append(ids)
        if waiting:
            found = self._encode({stem for _, _, stem in waiting}, special)
            for at, p, stem in waiting:
                ids = out[at] = found[stem] if p is stem else found[stem] + marks[p[-1]]
                if len(p) <= 64:
                    kept[p] = ids
                    kept[stem] = found[stem]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        data, offsets = text_bytes(texts)
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        cut = np.flatnonzero(data == 32)
        cut = cut[(cut > 0) & (cut < len(data) - 1)]
        after, before = data[cut + 1], data[cut - 1]
        sure = ~_BLANK[before] & ~_BLANK[after]
        # Blank characters of more than one byte, and others that begin or end alike: no cut beside them.
        sure &= ~(_LEADS[after] & _SECONDS[data[np.minimum(cut + 2, len(data) - 1)]])
        sure &= ~(_SECONDS[before] & (_LEADS[data[np.maximum(cut - 2, 0)]] & (data[np.maximum(cut - 2, 0)] == 0xC2))) & ~(_LEADS[data[np.maximum(cut - 3, 0)]] & _SECONDS[data[np.maximum(cut - 2, 0)]] & (before >= 0x80))
        cut = cut[sure]
        special = any(a in data.tobytes() for a in self.added)
        if special:
            whole = np.array([any(a in data[x:y].tobytes() for a in self.added) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            cut = cut[~whole[np.searchsorted(offsets, cut, side="right") - 1]]
        marks = np.zeros(len(data) + 1, bool)
        marks[offsets] = marks[cut] = True
        edges = np.flatnonzero(marks)
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        index = np.asarray(coded.indices)
        ids = self._of(coded.dictionary.to_pylist(), special)
        out, counts = gather(ids, index)
        owner = np.searchsorted(offsets, edges[:-1], side="right") - 1
        return out, np.bincount(owner, weights=counts, minlength=docs).astype(np.int64)


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One for each Python process, which serves several tasks."""
    return Encoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files; the manifest has part, seq, name, n_tokens in the order of documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = shared_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            content = write_shard(ids, np.concatenate(counts), np.concatenate(held))
            name = write_new(folder, ".wm", content)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name], "n_tokens": pa.array([size], pa.int64())})

        for batch in small_batches(batches, 8 << 20):
            coded, n = encoder.encode(batch.column(1))
            held.append(np.insert(coded, np.cumsum(n), end))
            counts.append(n + 1)
            ids += batch.column(0).to_pylist()
            size += len(held[-1])
            if size >= shard_tokens:
                yield flush()
                ids, held, counts, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    make_folder(folder)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    return dealt.mapInArrow(run, "part int, seq int, name string, n_tokens long")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Of each document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select("name", (F.col("base") + F.col("ahead")).alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_whole(folder, name))
                tokens = shard.tokens().astype("<u4")
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first), pa.array(shard.counts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to a new folder and report them as read back."""
    folder = working_dir(docs.sparkSession, "token-files")
    return read_tokens(store(write_tokens(docs, tokenizer, folder), "token-manifest"), folder)
