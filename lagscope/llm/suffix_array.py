"""Two-stage suffix sorting.

A suffix is of type S if it is smaller than the suffix after it, else of type L. Only S suffixes are
sorted directly. L suffixes follow from bucket scans: going through the buckets of first characters
upwards, each suffix found puts the L suffix before it at the next free place of that one's bucket,
since an L suffix is its first character and then a suffix that already has its place. Within a
bucket the L suffixes come first.

Strings are laid in a row with an end mark after each that is smaller than every character. Only
suffixes that are wanted, and those between them and the next S suffix, take part.
"""

from __future__ import annotations

import numpy as np


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes of a text whose last character is the smallest."""
    change = np.flatnonzero(text[:-1] != text[1:])
    rising = text[change] < text[change + 1]
    out = np.zeros(len(text), bool)
    out[: change[-1] + 1 if len(change) else 0] = np.repeat(rising, np.diff(np.concatenate(([-1], change))))
    return out


def sort_suffixes(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Wanted suffixes in order of their first ``depth`` characters at least.

    ``text``: characters from 1 up, 0 after each string; ``ends``: place of each suffix's end mark;
    ``wanted``: mask of suffixes.
    """
    is_s = suffix_types(text)
    places = np.arange(len(text))
    # A wanted L suffix needs all suffixes up to the next S suffix or end mark.
    stops = np.flatnonzero(is_s | (text == 0))
    reach = stops[np.searchsorted(stops, np.flatnonzero(wanted))]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, np.flatnonzero(wanted), 1)
    np.subtract.at(change, reach + 1, 1)
    taking = np.cumsum(change[:-1]) > 0

    direct = places[taking & is_s & (text > 0)]
    raw = (text - 1).astype(np.uint8).tobytes()
    keys = [raw[a:b] for a, b in zip(direct.tolist(), np.minimum(direct + depth, ends[direct]).tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    s_bounds = np.searchsorted(text[direct], np.arange(258))

    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def scan(found: np.ndarray) -> None:
        """Put the L suffixes before the found ones into their buckets, in order."""
        before = found[found > 0] - 1
        before = before[taking[before] & ~is_s[before] & (text[before] > 0)]
        if len(before):
            c = text[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cuts = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                waiting[c[a]].append(before[a:b])

    scan(places[(text == 0) & taking])
    for c in range(1, 257):
        while waiting[c]:  # more than one round for runs of this character
            found = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(found)
            scan(found)
        found = direct[s_bounds[c] : s_bounds[c + 1]]
        if len(found):
            out.append(found)
            scan(found)
    order = np.concatenate(out) if out else places[:0]
    return order[wanted[order]]


def same_as_before(text: np.ndarray, order: np.ndarray, length: int, rows: int = 1 << 14) -> np.ndarray:
    """Whether the common prefix of each suffix with the one before it in the order has ``length`` characters."""
    out = np.zeros(len(order), bool)
    step = np.arange(length)
    for at in range(1, len(order), rows):
        b = order[at : at + rows]
        a = order[at - 1 : at - 1 + len(b)]
        alive = np.flatnonzero((text[a] == text[b]) & (text[a + length - 1] == text[b + length - 1]))
        if len(alive):
            out[at + alive] = (text[a[alive, None] + step] == text[b[alive, None] + step]).all(axis=1)
    return out
