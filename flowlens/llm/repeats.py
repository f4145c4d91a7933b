"""Substring dedup by fixed-block anchors: exact repeats of a number of words, found in blocks.

Blocks of half a window are laid end to end over every document, so a repeat of ``window`` words
holds a whole block of each document it lies in. These non-overlapping blocks of all documents are
the index; every rolling run of block length probes it, and only windows around a hit can repeat.
Around hits, windows are compared whole: one that also starts in an earlier document is a repeat,
and overlapping repeats join to maximal ones.

Documents are dealt into chunks by hash, which ask by sorted hash lists (``lists``). Runs are
compared by hash, 48 bits for probes and 64 bits for whole windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.hashing import WHITESPACE, byte_codes, pieces, string_parts, window_hashes, word_hashes
from flowlens.llm.lists import CHUNK_CHARS, QUESTION, QUESTION_SQL, RANGE_CHARS, Distinct, merged, pack, slices, unpack
from flowlens.operators.shared import ship_with_tasks

for _module in (__name__, "flowlens.llm.hashing", "flowlens.llm.lists"):
    ship_with_tasks(_module)

LAST = (1 << 63) - 1  # place of rows without id
ANSWER = pa.schema([("chunk", pa.int64()), ("runs", pa.binary()), ("own", pa.binary())])
ANSWER_SQL = "chunk long, runs binary, own binary"


class Chunk:
    """Words of a chunk's documents in order of their ids."""

    def __init__(self, table: pa.Table):
        place = table.column("place").to_numpy()
        order = np.argsort(place, kind="stable")
        self.place = place[order]
        self.table = table.take(pa.array(order))
        self.data, self.offsets = string_parts(self.table.column("text"))
        codes = byte_codes(WHITESPACE)
        words, firsts, before = [], [np.zeros(1, np.int64)], 0
        for first, last in pieces(self.offsets):
            at = self.offsets[first]
            found, own = word_hashes(self.data[at : self.offsets[last]], self.offsets[first : last + 1] - at, codes)
            words.append(found)
            firsts.append(own[1:] + before)
            before += len(found)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.firsts = np.concatenate(firsts)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs that fit into their document, their starts, and their documents."""
        n = np.diff(self.firsts)
        document = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
        room = np.maximum(n - size + 1, 0)
        start = np.arange(len(document)) + np.repeat(self.firsts[:-1] - np.cumsum(room) + room, room)
        hashes = window_hashes(self.words, size)
        return hashes[start] if len(start) else np.zeros(0, np.uint64), start, document


def _ask_blocks(block: int, ranges: int):
    """Every distinct run of block length; marks: starts a block somewhere, lies in several documents."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        values, start, document = chunk.runs(block)
        found = Distinct(values >> np.uint64(16), chunk.place[document])
        anchored = found.any((start - chunk.firsts[document]) % block == 0)
        rows = [
            (i, pack(found.values[a:b]), np.packbits(np.stack([anchored[a:b], found.several[a:b]])).tobytes())
            for i, a, b in slices(found.values, ranges, 48)
        ]
        number = table.column("chunk")[0].as_py()
        parts = [[r[0] for r in rows], [number] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
        return pa.table(parts, schema=QUESTION)

    return run


def _find(table: pa.Table) -> pa.Table:
    """Runs that start a block of one document and lie in another one, for every chunk that has them."""
    chunks, lists, order, starts, sizes = merged(table)
    marks = np.concatenate(
        [
            np.unpackbits(np.frombuffer(raw, np.uint8), count=2 * len(x)).reshape(2, -1)
            for raw, x in zip(table.column("marks").to_pylist(), lists)
        ],
        axis=1,
    ).astype(bool)
    anchored = np.logical_or.reduceat(marks[0][order], starts)
    shared = (sizes > 1) | np.logical_or.reduceat(marks[1][order], starts)
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(anchored & shared, sizes)
    rows, at = [], 0
    for chunk, values in zip(chunks, lists):
        mine = values[hit[at : at + len(values)]]
        at += len(values)
        if len(mine):
            rows.append((chunk, pack(mine)))
    return pa.table([[r[0] for r in rows], [r[1] for r in rows], [b""] * len(rows)], schema=ANSWER)


def _holds(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _answers(table: pa.Table, column: str) -> np.ndarray:
    parts = [unpack(raw) for raw in table.column(column).to_pylist() if raw]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _ask_windows(window: int, block: int, ranges: int):
    """Every distinct window around a hit; marks: its first document's place, and if several have it."""

    def run(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows or not hits.num_rows:
            return QUESTION.empty_table()
        chunk = Chunk(table)
        known = _answers(hits, "runs")
        values, start, _ = chunk.runs(block)
        hit = np.zeros(len(chunk.words) + 1, np.int64)
        hit[start + 1] = _holds(known, values >> np.uint64(16))
        hits_before = np.cumsum(hit)
        values, start, document = chunk.runs(window)
        near = hits_before[start + window - block + 1] > hits_before[start]
        found = Distinct(values[near], chunk.place[document[near]])
        rows = [
            (i, pack(found.values[a:b]), _pack_places(found.first[a:b], found.several[a:b]))
            for i, a, b in slices(found.values, ranges, 64)
        ]
        number = table.column("chunk")[0].as_py()
        parts = [[r[0] for r in rows], [number] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
        return pa.table(parts, schema=QUESTION)

    return run


def _pack_places(first: np.ndarray, several: np.ndarray) -> bytes:
    low = int(first.min())
    above = (first - low).astype(np.uint64)
    narrow = int(above.max()) < 1 << 32
    head = np.array([low, narrow], np.int64).tobytes()
    return head + np.packbits(several).tobytes() + above.astype(np.uint32 if narrow else np.uint64).tobytes()


def _unpack_places(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, narrow = np.frombuffer(raw, np.int64, 2).tolist()
    bits = -(-n // 8)
    several = np.unpackbits(np.frombuffer(raw, np.uint8, bits, offset=16), count=n).astype(bool)
    above = np.frombuffer(raw[16 + bits :], np.uint32 if narrow else np.uint64)
    return above.astype(np.int64) + low, several


def _judge(table: pa.Table) -> pa.Table:
    """Per chunk: windows that an earlier document of another chunk has (runs), and windows of which
    the chunk itself has the earliest and further documents (own)."""
    chunks, lists, order, starts, sizes = merged(table)
    marks = [_unpack_places(raw, len(x)) for raw, x in zip(table.column("marks").to_pylist(), lists)]
    first = np.concatenate([m[0] for m in marks])
    earliest = np.zeros(len(order), np.int64)
    earliest[order] = np.repeat(np.minimum.reduceat(first[order], starts), sizes)
    rows, at = [], 0
    for chunk, values, (places, several) in zip(chunks, lists, marks):
        later = places > earliest[at : at + len(values)]
        at += len(values)
        runs, own = values[later], values[~later & several]
        if len(runs) or len(own):
            rows.append((chunk, pack(runs), pack(own)))
    return pa.table([[r[i] for r in rows] for i in range(3)], schema=ANSWER)


def _cut(window: int, keep_text: bool):
    """Mark the words that repeats cover and digest what is left."""
    from hashlib import sha256

    span = pa.struct([("start", pa.int64()), ("n", pa.int64())])
    fields = [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()), ("spans", pa.list_(span)),
    ]
    schema = pa.schema([*fields, ("kept_text", pa.string())] if keep_text else fields)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        chunk = Chunk(table)
        edges = np.zeros(len(chunk.words) + 1, np.int64)
        if answers.num_rows:
            values, start, document = chunk.runs(window)
            gone = _holds(_answers(answers, "runs"), values)
            mine = np.flatnonzero(_holds(_answers(answers, "own"), values))
            place = chunk.place[document[mine]]
            found = Distinct(values[mine], place)
            least = found.first[np.searchsorted(found.values, values[mine])]
            gone[mine[place > least]] = True
            np.add.at(edges, start[gone], 1)
            np.add.at(edges, start[gone] + window, -1)
        removed = np.cumsum(edges)[:-1] > 0
        before = np.append(0, np.cumsum(removed))
        counts = before[chunk.firsts[1:]] - before[chunk.firsts[:-1]]
        raw, offsets, firsts = chunk.data.tobytes(), chunk.offsets.tolist(), chunk.firsts.tolist()
        digests, spans, texts = [], [], []
        for i, n in enumerate(counts.tolist()):
            words = raw[offsets[i] : offsets[i + 1]].split()
            cut: list[dict] = []
            if n:
                inside = removed[firsts[i] : firsts[i + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                cut = [{"start": a, "n": b - a} for a, b in turns]
                words = [w for w, out in zip(words, inside.tolist()) if not out]
            kept = b" ".join(words)
            digests.append(sha256(kept).hexdigest())
            spans.append(cut)
            if keep_text:
                texts.append(kept.decode())
        columns = [chunk.table.column("doc_id"), np.diff(chunk.firsts), counts, digests, pa.array(spans, pa.list_(span))]
        return pa.table([*columns, texts] if keep_text else columns, schema=schema)

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = 50,
    keep_text: bool = False,
    chunk_chars: int = CHUNK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of every whole text that lie in a run of ``window`` words which also starts in an earlier document.

    Words stand between ASCII white space and count as they are written. Earlier means a smaller id;
    runs are judged on the input, not on what is left. Returns doc_id, n_words, n_removed, kept_sha256
    (of the words left, joined by one space), spans (start and n of each maximal removed stretch) and,
    if asked for, kept_text.

    Null and empty texts have no words. Rows without id come after all others and never before each
    other. Rows that share an id are no earlier than each other, so they lose nothing to one another.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    chunks, ranges = max(least, chars // chunk_chars), max(least, chars // RANGE_CHARS)
    block = max(1, window // 2)
    doc_id = F.col(id_col).cast("long")
    base = docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(LAST)).alias("place"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(chunks).cast("long")).alias("chunk"),
        text.alias("text"),
    )
    # One shuffle of the texts by chunk serves all three uses of ``base``.
    hits = base.groupBy("chunk").applyInArrow(_ask_blocks(block, ranges), QUESTION_SQL)
    hits = hits.groupBy("range").applyInArrow(_find, ANSWER_SQL)
    asked = base.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        _ask_windows(window, block, ranges), QUESTION_SQL
    )
    judged = asked.groupBy("range").applyInArrow(_judge, ANSWER_SQL)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, n: long>>"
    return base.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(
        _cut(window, keep_text), result + ", kept_text string" * keep_text
    )
