"""Words and hashes over the UTF-8 bytes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at a time, so that the work arrays stay in cache.
SLICE = 1 << 16

_BASE = 0x9E3779B97F4A7C15
#: One number for each byte, of two independent hashes.
_BYTE, _OTHER_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, (2, 256), dtype=U64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: One odd factor for each place of an n-gram.
_PLACE, _OTHER_PLACE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, (2, 64), dtype=U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser; changes ``x``."""
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        n = max(n, SLICE * 2)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, U64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix_sums(raw: np.ndarray, byte: np.ndarray = _BYTE) -> np.ndarray:
    """p with p[j] - p[i] = the polynomial of raw[i:j], times base**i."""
    p = np.empty(len(raw) + 1, U64)
    p[0] = 0
    np.cumsum(byte[raw] * powers(len(raw) + 1)[0][: len(raw)], out=p[1:])
    return p


def packed(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each begins (one entry more than texts).  Null is empty."""
    whole = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts
    if isinstance(whole, pa.ChunkedArray) or not len(whole):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    whole = whole.fill_null("").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses texts."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_BLANK[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = starts[(starts > 0) & (starts < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return lo, hi, np.searchsorted(starts, lo, "right") - 1


def span_hashes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, *, other: bool = False) -> np.ndarray:
    """64-bit hashes of raw[lo:hi] for spans in order that do not overlap; ``other`` gives a second, independent one."""
    byte = _OTHER_BYTE if other else _BYTE
    out = np.empty(len(lo), U64)
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + SLICE, "right")))
        base = lo[i]
        p = prefix_sums(raw[base : hi[j - 1]], byte)
        a, b = lo[i:j] - base, hi[i:j] - base
        out[i:j] = (p[b] - p[a]) * powers(len(p))[1][a] + (b - a).astype(U64)
        i = j
    return mix(out)


def word_grams(hashes: np.ndarray, text_of: np.ndarray, n: int, *, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they are of one text; both n - 1 shorter than the words."""
    place = _OTHER_PLACE if other else _PLACE
    m = max(len(hashes) - n + 1, 0)
    total = np.zeros(m, U64)
    for j in range(n if m else 0):
        total += hashes[j : j + m] * place[j]
    return mix(total), text_of[:m] == text_of[n - 1 :] if m else np.zeros(0, bool)


def sliding(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) over every ``width`` values in a row."""
    p = 1
    while 2 * p <= width:
        x = least(x[:-p], x[p:])
        p *= 2
    return least(x[: len(x) - (width - p)], x[width - p :]) if p < width else x


def first_of(
    keys: np.ndarray, *of: np.ndarray, second: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sorted distinct keys, each key's place among them, and least and largest of each further array by key.

    With a ``second`` half keys are equal where both halves are; the first of the arrays returned then has some values more than once.
    """
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if second is not None and (~new[1:] & (second[order[1:]] != second[order[:-1]])).any():
        order = np.lexsort((second, keys))
        ordered = keys[order]
        new[1:] = (ordered[1:] != ordered[:-1]) | (second[order[1:]] != second[order[:-1]])
    at = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    ranges = [
        (np.minimum.reduceat(x[order], at), np.maximum.reduceat(x[order], at)) if len(at) else (x[:0], x[:0]) for x in of
    ]
    return ordered[at], place, ranges
