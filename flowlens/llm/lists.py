"""Sorted hash lists: what a chunk of documents asks, cut by ranges of the hash space, and merged again.

A chunk sends each distinct hash once, so what very many documents share costs one entry per chunk;
a range's task merges the lists of all chunks and answers each with what concerns it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Text of a chunk, and of the lists that one range's task merges. For inputs beyond some ten TB the
# former should grow with the executors' memory, so that lists stay long.
CHUNK_CHARS = 8_000_000
RANGE_CHARS = 4_000_000
QUESTION = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("runs", pa.binary()), ("marks", pa.binary())])
QUESTION_SQL = "range int, chunk long, runs binary, marks binary"


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values, as 32-bit steps from the first where all steps are small enough."""
    if len(values) > 1:
        steps = np.diff(values)
        if int(steps.max()) < 1 << 32:
            return b"\1" + values[:1].tobytes() + steps.astype(np.uint32).tobytes()
    return b"\0" + values.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\0":
        return np.frombuffer(raw, np.uint64, offset=1)
    values = np.zeros((len(raw) - 5) // 4, np.uint64)
    values[0] = np.frombuffer(raw, np.uint64, 1, offset=1)[0]
    values[1:] = np.frombuffer(raw, np.uint32, offset=9)
    return np.cumsum(values, dtype=np.uint64)


class Distinct:
    """Distinct values in ascending order: how often each is there, its first place, and whether it has several."""

    def __init__(self, values: np.ndarray, place: np.ndarray):
        self.order = np.argsort(values, kind="stable")
        ranked = values[self.order]
        self.starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
        self.values = ranked[self.starts]
        ranked_place = place[self.order]
        ends = np.append(self.starts[1:], len(ranked))[: len(self.starts)] - 1
        self.first = ranked_place[self.starts]
        self.counts = ends + 1 - self.starts
        self.several = self.first != ranked_place[ends]

    def any(self, marked: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(marked[self.order], self.starts) if len(self.starts) else np.zeros(0, bool)


def slices(values: np.ndarray, ranges: int, bits: int) -> list[tuple[int, int, int]]:
    """Range number, begin and end of each range of the hash space that has values, of ``bits`` bits, ascending.

    The work grows with the values, not with the number of ranges.
    """
    # value * ranges / 2**bits, in halves of 32 bits as the product has up to 95.
    low = ((values & np.uint64(0xFFFFFFFF)) * np.uint64(ranges)) >> np.uint64(32)
    of = ((values >> np.uint64(32)) * np.uint64(ranges) + low) >> np.uint64(bits - 32)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    return list(zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)]))


def merged(table: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All lists of a range: chunks, lists, the order that sorts their values, and the run of each sorted value."""
    chunks = table.column("chunk").to_pylist()
    lists = [unpack(raw) for raw in table.column("runs").to_pylist()]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return chunks, lists, order, starts, np.diff(np.append(starts, len(ranked)))
