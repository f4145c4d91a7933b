"""Word and window hashes of whole Arrow string columns, computed with numpy inside tasks.

Words are runs of bytes outside a separator set; as all separators are ASCII, UTF-8 texts need no
decoding. A column is worked through in pieces of a few megabytes, so memory does not depend on
the size of a partition; a single longer text is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
PIECE_BYTES = 1 << 22

_ODD = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(separators: bytes = WHITESPACE, lower: bool = False) -> np.ndarray:
    """A 64-bit code for each byte; 0 for separators, one code for both cases if ``lower``."""
    values = np.arange(256, dtype=np.uint64)
    if lower:
        values[65:91] += np.uint64(32)
    codes = mix(values * np.uint64(_ODD) + np.uint64(1)) | np.uint64(1)
    codes[list(separators)] = 0
    return codes


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    where = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within ``limit`` unless one row alone exceeds it."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_starts(
    data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, kinds: np.ndarray | None = None
) -> np.ndarray:
    """Byte positions at which a word starts; no word crosses the end of a text.

    ``kinds`` numbers the bytes; a word also ends where kinds 1 and 2 meet.
    """
    inside = codes[data] != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    if kinds is not None:
        kind = kinds[data]
        begins[1:] |= kind[1:] * kind[:-1] == 2
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    return np.flatnonzero(begins)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, kinds: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and for each text the index of its first word (one more at the end)."""
    return hashes_at(data, offsets, codes, word_starts(data, offsets, codes, kinds))


def hashes_at(
    data: np.ndarray, offsets: np.ndarray, codes: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same for words of known starts."""
    firsts = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    spans = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, spans)
    scaled = codes[data[starts[0] :]] * powers(_STEP, int(spans.max()))[at]
    return mix(np.add.reduceat(scaled, starts - starts[0])), firsts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive values, whatever texts they belong to."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_ODD, len(words)), out=sums[1:])
    back = powers(pow(_ODD, -1, 1 << 64), n)
    return mix((sums[size:] - sums[:n]) * back)
