"""Numpy views of Arrow text columns: whole batches are split into words and hashed without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: Space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_M = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string column; null counts as the empty string."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def segments(data: np.ndarray, most: int, overlap: int = 0, separator: np.ndarray = ASCII_SPACE) -> Iterator[tuple[np.ndarray, int, int]]:
    """Pieces of a long text of about ``most`` bytes, cut between words: the piece, the number of its first word in the
    text, and how many of its first words the piece before had too (``overlap``, none in the first piece).

    A piece has more than ``overlap`` words, however long they are, unless the text ends before."""
    at = word = repeated = 0
    while True:
        size = most
        while True:
            end = at + size
            if end >= len(data):
                yield data[at:], word, repeated
                return
            gaps = np.flatnonzero(separator[data[end : end + most]])
            end = end + int(gaps[0]) if len(gaps) else end + most
            gap = separator[data[at:end]]
            starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
            whole = end >= len(data) or separator[data[end]]
            if whole and len(starts) > 2 * overlap:
                break
            size *= 2
        yield data[at:end], word, repeated
        word, repeated = word + len(starts) - overlap, overlap
        at += int(starts[-overlap]) if overlap else end - at


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row its first word (one entry more than rows)."""
    gap = separator[data]
    before = np.concatenate(([True], gap[:-1])) if len(gap) else gap
    after = np.concatenate((gap[1:], [True])) if len(gap) else gap
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = True
    after[cut - 1] = True
    starts = np.flatnonzero(~gap & before)
    return starts, np.flatnonzero(~gap & after) + 1, np.searchsorted(starts, offsets)


def word_bounds(data: np.ndarray, separator: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of one text, found in pieces, so that little more than the result is held."""
    starts, ends, before = [], [], True
    for lo in range(0, len(data), CHUNK_BYTES):
        gap = separator[data[lo : lo + CHUNK_BYTES]]
        last = np.concatenate(([before], gap[:-1]))
        starts.append(np.flatnonzero(~gap & last) + lo)
        ends.append(np.flatnonzero(gap & ~last) + lo)
        before = bool(gap[-1])
    if not before:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def joined_words(raw: bytes, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> bytes:
    """Words ``lo`` to ``hi`` of a text with one space between them."""
    step = 100_000
    return b" ".join([b" ".join(raw[starts[a] : ends[min(a + step, hi) - 1]].split()) for a in range(lo, hi, step)])


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64; those for two chunks of text are kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if len(have) <= 2 * CHUNK_BYTES + 1:
            _POWERS[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, from prefix sums modulo 2**64, then mixed."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _powers(_M, n + 1)[:n], dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(pow(_M, -1, 1 << 64), n + 1)[starts] + (ends - starts).astype(U64))


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    if len(a) < width:
        return a[:0]
    span = 1
    while span * 2 <= width:
        a, span = np.minimum(a[:-span], a[span:]), span * 2
    return np.minimum(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """A list column of consecutive runs of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
