"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` reads a model file into a transducer of three parts: the normaliser (one space in front,
spaces written as U+2581), a trie of all pieces whose last arcs put out piece ids, and byte-fallback arcs
for characters without a piece. Composing it with a text gives a lattice whose paths are segmentations.

Weights are tropical. For unigram models an arc weighs minus its piece's score. A BPE model's
encoding is no sum of scores: it is the one segmentation of which every adjacent pair of pieces is
what the merges make of the pair's own text. So the lattice is composed with an acceptor whose
states are the last piece, and whose arcs weigh zero for such pairs and infinity for others; exactly
one path is finite. No path weighs less than zero, so a best-first search that tries long arcs first
may stop at the first complete path of weight zero.

Texts are cut where no piece has the two characters side by side, which no path can cross, and the
results of parts are kept. Any text is encoded whole, whatever its length.

Null texts have null ids and null text; empty ones an empty list. Null doc_ids and repeated rows are kept
as they are. Empty table: no rows. Other columns are not read, or passed on by the pipeline.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lagscope.llm.arrays import gather, small_batches, text_bytes

SPACE = "▁"
# Entries kept by a Python process, which serves tasks of other operators as well.
KEPT = 100_000
PAIRS = 300_000

# Kinds of pieces in a model file, and what an unknown piece reads as.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_TEXT = " ⁇ "


class Transducer:
    """The compiled model, and searches in its composition with texts."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only identity normalisation that keeps and escapes spaces is compiled")
        self.prefix = rules.add_dummy_prefix
        self.bpe = model.trainer_spec.model_type == BPE
        self.names = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.ids = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k in (NORMAL, USER_DEFINED, UNUSED)}
        # Trie: a state is a dict of arcs by character; the arc "" ends a piece.
        self.trie: dict = {}
        self.beside: set[str] = set()
        for name, i in self.ids.items():
            state = self.trie
            for c in name:
                state = state.setdefault(c, {})
            state[""] = i
            self.beside.update(map("".join, zip(name, name[1:], strict=False)))
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def arcs(self, text: str, at: int) -> list[tuple[int, int | None]]:
        """Arcs of the lattice from a place: (next place, piece), longest first; None: byte fallback."""
        state, out = self.trie, []
        for j in range(at, len(text)):
            state = state.get(text[j])
            if state is None:
                break
            if "" in state:
                out.append((j + 1, state[""]))
        if not out or out[0][0] != at + 1:
            out.insert(0, (at + 1, None))
        return out[::-1]

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text: the best-scored neighbours first, the leftmost of equals."""
        symbols = list(text)
        while len(symbols) > 1:
            best = None
            for i in range(len(symbols) - 1):
                piece = self.ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = self.scores[piece], i
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def follows(self, last: int | None, new: int | None, before: str, after: str) -> bool:
        """Whether the pair's arc weighs zero, given as pieces and as texts. ``before`` is empty at the start."""
        if new is None or (before and last is None):
            return self.merged(before + after) == ([before, after] if before else [after])
        key = (last + 1 if before else 0) << 32 | new
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(before + after) == ([before, after] if before else [after])
        return known

    def output(self, text: str, piece: int | None) -> list[int]:
        if piece is not None:
            return [piece]
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def shortest(self, text: str) -> list[int]:
        """The piece ids of the shortest path."""
        return self._first_of_weight_zero(text) if self.bpe else self._viterbi(text)

    def _first_of_weight_zero(self, text: str) -> list[int]:
        dead: set[tuple[int, int]] = set()  # (start, end) of a last arc from which nothing leads on
        path: list[tuple[int, int, int | None]] = []
        waiting = [iter(self.arcs(text, 0))]
        at = 0
        while at < len(text):
            begin, end, last = path[-1] if path else (0, 0, None)
            before = text[begin:end]
            for to, piece in waiting[-1]:
                if (at, to) not in dead and self.follows(last, piece, before, text[at:to]):
                    path.append((at, to, piece))
                    waiting.append(iter(self.arcs(text, to)))
                    at = to
                    break
            else:
                if not path:
                    raise ValueError(f"no path for {text!r}")
                waiting.pop()
                start, end, _ = path.pop()
                dead.add((start, end))
                at = start
        return [i for a, b, piece in path for i in self.output(text[a:b], piece)]

    def _viterbi(self, text: str) -> list[int]:
        best: list[tuple[float, int, int | None]] = [(0.0, 0, None)] + [(math.inf, 0, None)] * len(text)
        none = min(self.scores[i] for i in self.ids.values()) - 10
        for at in range(len(text)):
            for to, piece in self.arcs(text, at):
                weight = best[at][0] - (none if piece is None else self.scores[piece])
                if weight < best[to][0]:
                    best[to] = weight, at, piece
        out, at = [], len(text)
        while at:
            _, start, piece = best[at]
            out.append(self.output(text[start:at], piece))
            at = start
        return [i for ids in reversed(out) for i in ids]

    def encode_normal(self, text: str) -> list[int]:
        """Ids of normalised text: cut where no path can cross, and search each part."""
        out: list[int] = []
        begin = 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in self.beside:
                part = text[begin:i]
                ids = self.parts.get(part)
                if ids is None:
                    ids = tuple(self.shortest(part))
                    if len(part) <= 64:
                        if len(self.parts) > KEPT:
                            self.parts.clear()
                        self.parts[part] = ids
                out += ids
                begin = i
        return out

    def normalise(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def encode(self, text: str) -> list[int]:
        return self.encode_normal(self.normalise(text))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the transducer read backwards. Bytes that are no UTF-8 read as U+FFFD each."""
        raw = b"".join(self.spelled(i) for i in ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        if self.prefix and first is not None and self.names[first][0] == SPACE:
            raw = raw[1:]
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [raw[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out)

    def spelled(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.names[i][1:-1], 16)])
        return b"" if kind == CONTROL else (UNKNOWN_TEXT if kind == UNKNOWN else self.names[i].replace(SPACE, " ")).encode()

    def encode_batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch in a row, and how many each has."""
        data, offsets = text_bytes(column)
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(docs, np.int64)
        if self.prefix:
            filled = offsets[:-1] < offsets[1:]
            data = np.insert(data, offsets[:-1][filled], 32)
            offsets = offsets + np.concatenate(([0], np.cumsum(filled)))
        blank = data == 32
        cut = np.flatnonzero(blank)
        cut = cut[cut > 0]
        written = (data[np.maximum(cut - 3, 0)] == 0xE2) & (data[np.maximum(cut - 2, 0)] == 0x96) & (data[cut - 1] == 0x81)
        cut = cut[~blank[cut - 1] & ~written]
        crossing = any(p[0] != SPACE and p[1] == SPACE for p in self.beside)
        marks = np.zeros(len(data) + 1, bool)
        marks[offsets] = True
        if not crossing:
            marks[cut] = True
        edges = np.flatnonzero(marks)
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}  # what is still in use comes back from the older ones
        words, ids = coded.dictionary.to_pylist(), []
        for word in words:
            known = self.kept.get(word)
            if known is None:
                known = self.older.get(word) or np.array(self.encode_normal(word.decode().replace(" ", SPACE)), "<u4").tobytes()
                if len(word) <= 64:
                    self.kept[word] = known
            ids.append(known)
        out, counts = gather(ids, np.asarray(coded.indices))
        owner = np.searchsorted(offsets, edges[:-1], side="right") - 1
        return out, np.bincount(owner, weights=counts, minlength=docs).astype(np.int64)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of id sequences laid in a row."""
        if not hasattr(self, "_spellings"):
            spellings = [self.spelled(i) for i in range(len(self.names))]
            sizes = np.array([len(s) for s in spellings], np.int64)
            self._spellings = np.frombuffer(b"".join(spellings), np.uint8), sizes, np.cumsum(sizes) - sizes
        flat, sizes, first = self._spellings
        n = sizes[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        raw = flat[np.repeat(first[ids] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        if self.prefix:
            heads = bounds[:-1][bounds[:-1] < bounds[1:]]
            heads = heads[raw[heads] == 32]  # ids of texts begin with no byte piece of a space
            raw = np.delete(raw, heads)
            bounds = bounds - np.searchsorted(heads, bounds)
        texts = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            ends = np.cumsum(counts)
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends - counts, ends, strict=True)], pa.string())


@lru_cache(maxsize=2)
def compile_model(path: str) -> Transducer:
    """One for each Python process, which serves several tasks."""
    return Transducer(path)


def with_pieces(docs: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and the ids of ``text`` and the text that they read as."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(model)
        for batch in small_batches(batches, 2 << 20):
            text = batch.column(batch.schema.get_field_index("text"))
            flat, counts = machine.encode_batch(text)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            null = np.asarray(pc.is_null(text))
            starts = pa.array(ends, pa.int32(), mask=np.append(null, False))
            lists = pa.ListArray.from_arrays(starts, pa.array(flat.astype(np.int32)))
            back = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), machine.decode_batch(flat, counts))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, back], [*batch.schema.names, ids, decoded])

    schema = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType())).add(decoded, StringType())
    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids of each row read as. Null ids: null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(model)
        for batch in batches:
            texts = [None if v is None else machine.decode(v) for v in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, decoded])

    return rows.mapInArrow(run, StructType(list(rows.schema.fields)).add(decoded, StringType()))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether the ids read as the text again (with U+2581 as a space)."""
    rows = with_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    same = F.col("decoded") == F.replace(F.col("text"), F.lit(SPACE), F.lit(" "))
    return rows.select("doc_id", "ids", F.size("ids").alias("n_tokens"), same.alias("round_trip"))
