"""A wavelet matrix of token ids in one compressed file.

Bit-planes from the highest bit down; after each plane the sequence is parted stably into zeros and
ones. With counts of ones before every block of a plane (``rank``) and their inverse (``select``),
the file answers which token stands at a place, how often a token occurs before a place, and where
its occurrences are, without the sequence itself.

Layout: magic, length of the header, header (JSON), then zstandard sections: ids and token counts
of documents, and for each plane its bits and its block counts. Sections are found through the
header, and a reader expands a plane when it first needs it.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

MAGIC = b"WAVMTX01"
BLOCK = 512


def build_planes(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes from the highest bit down, and how many zeros each has."""
    planes, zeros = [], []
    now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for b in range(bits - 1, -1, -1):
        plane = np.packbits((now & now.dtype.type(1 << b)).astype(bool), bitorder="little")
        # A plane is the bitmap that Arrow filters by.
        values = pa.array(now)
        low, high = (np.asarray(pc.array_filter(values, pa.Array.from_buffers(pa.bool_(), len(now), [None, pa.py_buffer(m)]))) for m in (~plane, plane))
        planes.append(plane)
        zeros.append(len(low))
        now = np.concatenate((low, high))
    return planes, zeros


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of the given documents: ids of all of them in one sequence."""
    bits = max(int(ids.max()).bit_length() if len(ids) else 1, 1)
    planes, zeros = build_planes(ids, bits)
    press = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [press(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), press(known.tobytes()), press(counts.astype("<i8").tobytes())]
    for plane in planes:
        padded = np.pad(plane, (0, -len(plane) % (BLOCK // 8)))
        ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
        parts += [press(plane.tobytes()), press((np.cumsum(ones) - ones).astype("<u4").tobytes())]
    header = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "docs": len(doc_ids), "sizes": [len(p) for p in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


class Shard:
    """Reader of one file."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", content[8:12])
        head = json.loads(content[12 : 12 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self._at = np.concatenate(([0], np.cumsum(head["sizes"]))) + 12 + size
        self._content = content
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        known = np.frombuffer(self._section(1), np.uint8)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(self._section(0), "<i8"), known, strict=True)]
        self.counts = np.frombuffer(self._section(2), "<i8")

    def _section(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._content[self._at[k] : self._at[k + 1]])

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            self._planes[level] = np.frombuffer(self._section(3 + 2 * level), np.uint8), np.frombuffer(self._section(4 + 2 * level), "<u4")
        return self._planes[level]

    def _bit(self, level: int, at: int) -> int:
        return int(self._plane(level)[0][at >> 3] >> (at & 7)) & 1

    def _ones(self, level: int, to: int) -> int:
        """Ones of a plane before a place."""
        plane, before = self._plane(level)
        block = to // BLOCK
        if block == len(before):
            return self.n - self.zeros[level]
        start = block * BLOCK // 8
        part = plane[start : to >> 3]
        rest = int(plane[to >> 3]) & ((1 << (to & 7)) - 1) if to & 7 else 0
        return int(before[block]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) zero or one of a plane."""
        plane, before = self._plane(level)
        upto = before if bit else np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(upto, k, side="right")) - 1
        raw = np.unpackbits(plane[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(raw == bit)[k - int(upto[block])])

    def access(self, at: int) -> int:
        """The token at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, token: int, to: int) -> tuple[int, int]:
        low, high = 0, to
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, to: int) -> int:
        """Occurrences of a token before a place."""
        low, high = self._range(token, to)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th occurrence of a token, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.occurrence(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self._plane(level)[0], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[~ones] = now[: self.zeros[level]]
            up[ones] = now[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            now = up
        return now.astype(np.uint32)
