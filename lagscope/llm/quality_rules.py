"""Rules on repetition and form that decide whether a text is kept.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are parted by ``\\n``. For each length of ``TOP`` the words
inside the most frequent n-gram, and for each length of ``DUPLICATED`` the words inside n-grams
found twice or more, are measured in characters against the characters in all words. N-grams are
compared by 64-bit rolling hashes of word numbers, for a whole batch of texts at once.

Null text: as the empty text (no words, which fails the base rule). Null ids and repeated rows: each
row gets its own result. Texts of any length are measured whole. Empty table: no rows. Other
columns, whatever their names, are not read and not returned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lagscope.llm.arrays import find_words, mix, small_batches, text_bytes, word_array, word_ids

# Published limits on repetition, as shares of a text's characters in words.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS = 0.20
LINES = 0.30
SYMBOLS_PER_WORD = 0.10

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, top_share double, dup_share double, dup_line_share double"
)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of equal keys for each entry, and whether it is not the first of them."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    count, later = np.empty(len(key), np.int64), np.empty(len(key), bool)
    count[order] = np.bincount(group)[group] if len(key) else 0
    later[order] = ~new
    return count, later


def _covered(marked: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside an n-gram that is marked at its first word."""
    change = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(marked)
    change[at] += 1
    np.subtract.at(change, at + n, 1)
    return np.cumsum(change[:-1]) > 0


def measure(text: pa.Array, top: dict[int, float], duplicated: dict[int, float]) -> dict[str, np.ndarray]:
    """All measures of a batch of texts."""
    data, offsets = text_bytes(text)
    docs = len(offsets) - 1
    start, end, doc, inside = find_words(data, offsets)
    ids, _ = word_ids(word_array(data, inside, start, end))
    n_words = np.bincount(doc, minlength=docs)
    leading = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = leading[end] - leading[start]
    per_doc = lambda weight: np.bincount(doc, weights=weight, minlength=docs).astype(np.int64)
    word_chars = per_doc(chars)
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[data])))

    # Lines with a word: a line is known by its first word; equal lines are equal bytes.
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate((offsets[:-1], breaks + 1, offsets)))
    line_of = np.searchsorted(edges, start, side="right") - 1
    lines = np.unique(line_of)
    begin = edges[lines]
    stop = edges[lines + 1] if len(lines) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10) if len(lines) else 0)
    line_doc = np.searchsorted(offsets, begin, side="right") - 1
    blob = data.tobytes()
    seen: dict[tuple[int, bytes], int] = {}
    line_key = np.array([seen.setdefault((d, blob[a:b]), len(seen)) for d, a, b in zip(line_doc.tolist(), begin.tolist(), stop.tolist(), strict=True)], dtype=np.int64)
    _, later = _repeated(line_key)
    n_dup_lines = np.bincount(line_doc[later], minlength=docs) if len(lines) else np.zeros(docs, np.int64)
    n_lines = np.bincount(line_doc, minlength=docs) if len(lines) else np.zeros(docs, np.int64)
    in_words = np.bincount(np.searchsorted(lines, line_of), weights=chars, minlength=len(lines))
    dup_line_chars = np.bincount(line_doc[later], weights=in_words[later], minlength=docs) if len(lines) else np.zeros(docs)
    line_chars = np.bincount(line_doc, weights=in_words, minlength=docs) if len(lines) else np.zeros(docs)

    total = np.maximum(word_chars, 1)
    chars_to = np.concatenate(([0], np.cumsum(chars)))
    bad_top, bad_dup = np.zeros(docs, bool), np.zeros(docs, bool)
    top_share, dup_share, n_repeat = np.zeros(docs), np.zeros(docs), np.zeros(docs, np.int64)
    code, multiplier = mix(ids + 1), np.uint64(0x9E3779B97F4A7C15)
    salt = mix(doc.astype(np.uint64) + np.uint64(1) << np.uint64(32))
    rolling, length = code.copy(), 1
    for n in sorted({3, *top, *duplicated}):
        while length < n:  # add the next word to every n-gram
            rolling = rolling[:-1] * multiplier + code[length:] if len(rolling) else rolling
            length += 1
        m = max(len(ids) - n + 1, 0)
        whole = doc[:m] == doc[n - 1 :] if m else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        count, _ = _repeated(mix(rolling[:m][at] ^ salt[at]))
        marked = np.zeros(m, bool)
        marked[at] = count > 1
        if n == 3:
            n_repeat = per_doc(_covered(marked, n, len(ids)))
        if n in duplicated:
            share = np.bincount(doc, weights=chars * _covered(marked, n, len(ids)), minlength=docs) / total
            bad_dup |= share > duplicated[n]
            dup_share = np.maximum(dup_share, share)
        if n in top:
            share = np.zeros(docs)
            held = count > 1
            np.maximum.at(share, doc[at[held]], (count * (chars_to[at + n] - chars_to[at]))[held] / total[doc[at[held]]])
            bad_top |= share > top[n]
            top_share = np.maximum(top_share, share)
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    dup_line_share = dup_line_chars / np.maximum(line_chars, 1)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    bad = bad_top | bad_dup | (dup_line_share > LINE_CHARS) | (n_dup_lines > LINES * n_lines) | (n_symbols > SYMBOLS_PER_WORD * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & ~bad,
        "top_share": top_share, "dup_share": dup_share, "dup_line_share": dup_line_share,
    }


def quality_rules(docs: DataFrame, top: dict[int, float] | None = None, duplicated: dict[int, float] | None = None) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every row of (doc_id, text)."""
    top, duplicated = TOP if top is None else top, DUPLICATED if duplicated is None else duplicated

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2 << 20):
            out = measure(batch.column(1), top, duplicated)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], ["doc_id", *out])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
