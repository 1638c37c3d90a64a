"""Vectorised word and shingle hashing over Arrow string batches.

All helpers work on whole texts of one Arrow batch at a time: the bytes of the
batch are one flat array, and every step is one numpy pass over it.  A word is a
maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; ``A-Z`` is lower-cased.
Null and empty texts have no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    codes = mix(low.astype(np.uint64) + U64(0x5851F42D4C957F2D))
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return codes, blank


_CODES, _BLANK = _byte_codes()
#: Bytes whose values are in memory at a time.
_PIECE = 1 << 18


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in text order, and the offsets of each text's words."""
    starts, ends = word_bounds(raw, offsets)
    counts = np.searchsorted(starts, offsets)
    return _span_hashes(raw, starts, ends), counts.astype(np.int64)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a word never crosses a text's border."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_BLANK[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    border = offsets[1:-1]
    border = border[border < len(raw)]
    begin[border] = inside[border]
    finish = np.zeros(len(raw), dtype=bool)
    finish[:-1] = inside[:-1] & (~inside[1:] | begin[1:])
    finish[-1] = inside[-1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def _span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for sorted, disjoint spans of any length.

    Each (byte, place in the span) has a mixed 64-bit value of its own and a span has the sum of them; so
    no algebra between places exists by which words built on a pattern, such as Thue-Morse words, would clash."""
    n = len(starts)
    first, last = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    carry, anchor = U64(0), 0
    for lo in range(0, len(raw) if n else 0, _PIECE):
        part = raw[lo : lo + _PIECE]
        hi = lo + len(part)
        s0, s1 = np.searchsorted(starts, [lo, hi])
        since = np.full(len(part), anchor, dtype=np.int64)
        since[starts[s0:s1] - lo] = starts[s0:s1]
        since = np.maximum.accumulate(since)
        anchor = int(since[-1])
        places = (np.arange(lo, hi, dtype=np.int64) - since).astype(np.uint64)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(mix(_CODES[part] + places * U64(0x9E3779B97F4A7C15)), out=total[1:])
        total += carry  # sums wrap modulo 2^64, so differences stay right
        first[s0:s1] = total[starts[s0:s1] - lo]
        e0, e1 = np.searchsorted(ends, [lo + 1, hi + 1])
        last[e0:e1] = total[ends[e0:e1] - lo]
        carry = total[-1]
    return mix(last - first + (ends - starts).astype(np.uint64))


def shingle_sets(words: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within the text, with offsets.

    A text of 1 to ``width - 1`` words has its whole word sequence as its one shingle;
    a text without words has none.
    """
    n_docs = len(counts) - 1
    lens = np.diff(counts)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), lens)
    pos_end = np.repeat(counts[1:], lens)
    idx = np.arange(n, dtype=np.int64)
    full = idx + width <= pos_end
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: max(n - k, 0)] = words[k:]
        h = h * U64(0xD6E8FEB86659FD93) + np.where(idx + k < pos_end, shifted, U64(0))
    keep = full | ((idx == np.repeat(counts[:-1], lens)) & (np.repeat(lens, lens) < width))
    short = np.minimum(np.repeat(lens, lens), width).astype(np.uint64)
    h = mix(h + short)[keep]
    doc = doc[keep]
    return distinct_within(h, doc, n_docs)


def distinct_within(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document; ``doc`` is non-decreasing."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    parts, sizes = [], np.zeros(n_docs + 1, dtype=np.int64)
    for i in range(n_docs):
        part = np.sort(h[bounds[i] : bounds[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        sizes[i + 1] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
