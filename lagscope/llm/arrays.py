"""Text columns as numpy arrays, and packed arrays as table values.

Tasks read Arrow batches; the helpers here view the bytes of a text column without copying rows
into Python strings, and find the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry than rows). Null: empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_batches(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text is a batch by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, its text's number, and the mask of bytes inside words.

    ``space`` has True for the bytes that part words.
    """
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1, inside


def word_array(data: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as one Arrow binary column."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )


def word_ids(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's index into the distinct words, and the distinct words."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def gather(values: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of the values that ``index`` names, in a row, and how many each place has."""
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    flat, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
    counts = sizes[index]
    total = np.cumsum(counts)
    return flat[np.repeat(first[index] - total + counts, counts) + np.arange(total[-1] if len(total) else 0)], counts


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finisher of splitmix64); one to one."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value. Byte planes are laid apart, so that high zero bytes cost nothing."""
    parts = []
    for a in arrays:
        if isinstance(a, bytes):
            parts.append((None, 0, a))
        else:
            a = np.ascontiguousarray(a)
            parts.append((a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, 5))


def unpack(value: bytes) -> list:
    """The arrays given to ``pack``."""
    out: list = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(value)):
        if kind is None:
            out.append(raw)
        else:
            planes = np.frombuffer(raw, np.uint8).reshape(-1, n) if n else np.zeros((np.dtype(kind).itemsize, 0), np.uint8)
            out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
    return out


def pack_sorted(values: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned values, which pack into fewer bytes."""
    return np.diff(values.astype(np.uint64), prepend=np.uint64(0))


def unpack_sorted(steps: np.ndarray) -> np.ndarray:
    """The values given to ``pack_sorted``."""
    return np.cumsum(steps, dtype=np.uint64)
