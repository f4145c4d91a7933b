"""Periodic runs of words, found with a dictionary of basic factors.

Factors of 1, 2, 4, ... words get names, so that equal factors of one document have one name. A run of
period p, where 2L <= p < 4L for a power of two L, is at least 2p words long, so some multiple of L starts a
factor of L words which stands again p words on, still inside the run. Hence for every such anchor the
successor occurrences of its factor, in the stretch of twice its length that begins 2L on, propose all
periods. They form arithmetic progressions; the progression that starts at the anchor itself, with a step of
at most L, is a run of that step, which a shorter length proposes, and is passed over whole. So a length
makes at most two proposals a word, mostly none. Each is extended to both sides by comparing names from the
longest length down, and equal stretches are merged under their smallest period.

Names of factors that occur once are not kept on: longer factors around them occur once as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.hashing import pieces, string_parts
from flowlens.operators.shared import ship_with_tasks

for _module in (__name__, "flowlens.llm.hashing"):
    ship_with_tasks(_module)

NONE = -1


class Factors:
    """Names of all factors of 1, 2, 4, ... words that occur more than once; other places hold -1.

    ``words`` numbers the words so that no number stands in two documents. Then a factor over the end of a
    document occurs once: its two halves meet nowhere else.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.names: list[np.ndarray] = []
        self.groups: list[tuple[np.ndarray, np.ndarray]] = []
        place, key, length = np.arange(self.n), words.astype(np.int64), 1
        while len(place):
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            sizes = np.diff(np.append(starts, len(ranked)))
            group = np.repeat(np.arange(len(starts)), sizes)
            several = np.repeat(sizes > 1, sizes)
            ranked_place, ranked_group = place[order][several], group[several]
            if not len(ranked_place):
                break
            names = np.full(self.n, NONE, np.int64)
            names[ranked_place] = ranked_group
            self.names.append(names)
            self.groups.append((ranked_group, ranked_place))
            place = np.flatnonzero((names[: max(self.n - length, 0)] >= 0) & (names[length:] >= 0))
            key = names[place] * self.n + names[place + length]
            length *= 2

    def proposals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors and periods from 2L to 4L - 1 that factors of L = 2 ** level words propose."""
        length = 1 << level
        group, place = self.groups[level]
        names, width = self.names[level], self.n + 1
        anchors = np.arange(0, self.n, length)
        anchors = anchors[names[anchors] >= 0]
        ranked = group * width + place
        own = names[anchors] * width
        low = np.searchsorted(ranked, own + np.minimum(anchors + 2 * length, self.n))
        high = np.searchsorted(ranked, own + np.minimum(anchors + 4 * length, self.n))
        # The progression that each occurrence starts: its step, and the rank after its last member.
        step = np.where(group[1:] == group[:-1], place[1:] - place[:-1], 0)
        turns = np.append(np.flatnonzero(step[1:] != step[:-1]) + 1, len(step))
        rank = np.searchsorted(ranked, own + anchors)
        inside = np.flatnonzero(rank < len(step))
        near = inside[(step[rank[inside]] > 0) & (step[rank[inside]] <= length)]
        after = turns[np.searchsorted(turns, rank[near], side="right")] + 1
        low[near] = np.maximum(low[near], after)
        counts = np.maximum(high - low, 0)
        start = np.repeat(anchors, counts)
        at = np.arange(len(start)) + np.repeat(low - np.cumsum(counts) + counts, counts)
        return start, place[at] - start

    def extended(self, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word, and the one after the last, of the longest stretch of a period around each start."""
        left, right = start.copy(), start + period
        for level in range(len(self.names) - 1, -1, -1):
            names, length = self.names[level], 1 << level
            there = np.minimum(right, self.n - 1)
            name = names[there]
            same = (right < self.n) & (name >= 0) & (name == names[there - period])
            right = right + np.where(same, length, 0)
            back = np.maximum(left - length, 0)
            name = names[back]
            other = np.minimum(back + period, self.n - 1)
            same = (left >= length) & (name >= 0) & (name == names[other])
            left = left - np.where(same, length, 0)
        return left, right


def periodic_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period.

    A run has at least ``least`` words and two periods, and no neighbouring word extends it.
    """
    factors = Factors(words)
    same = words[1:] == words[:-1]
    found = [np.flatnonzero(same & np.append(True, ~same[:-1]))[: len(same)]]
    periods = [np.ones(len(found[0]), np.int64)]
    for level in range(len(factors.names)):
        start, period = factors.proposals(level)
        found.append(start)
        periods.append(period)
    start, period = np.concatenate(found), np.concatenate(periods)
    left, right = factors.extended(start, period)
    whole = right - left >= np.maximum(least, 2 * period)
    left, right, period = left[whole], right[whole], period[whole]
    order = np.lexsort((period, right, left))
    left, right, period = left[order], right[order], period[order]
    first = np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))[: len(left)]
    left, right, period = left[first], right[first], period[first]
    order = np.lexsort((period, left))
    return left[order], (right - left)[order], period[order]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLUMNS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()),
    ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
    ("collapsed_sha256", pa.string()), ("runs", pa.list_(RUN)),
]
RESULT_SQL = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"
)


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word, the same for equal words of one document only."""
    numbers: list[int] = []
    base = 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers.extend([known.setdefault(w, base + len(known)) for w in words])
        base += len(known)
    return np.array(numbers, np.int64)


def _described(ids: list, texts: list[list[bytes]], least: int, keep_text: bool) -> list[tuple]:
    firsts = np.append(0, np.cumsum([len(t) for t in texts]))
    start, length, period = periodic_runs(_numbered(texts), least)
    edges = np.zeros(firsts[-1] + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    dropped = np.cumsum(edges)[:-1] > 0
    cut = np.searchsorted(start, firsts).tolist()
    rows = []
    for i, (doc_id, words) in enumerate(zip(ids, texts)):
        a, b, at = cut[i], cut[i + 1], int(firsts[i])
        runs = [
            {"start": s - at, "length": n, "period": p}
            for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())
        ]
        listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
        best: tuple = (None,) * 4
        if runs:
            top = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]))
            best = (top["start"], top["length"], top["period"], 1000 * top["length"] // top["period"])
            words = [w for w, out in zip(words, dropped[at : at + len(words)].tolist()) if not out]
        kept = b" ".join(words)
        digests = (sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest())
        text = (kept.decode(),) if keep_text else ()
        rows.append((doc_id, int(firsts[i + 1]) - at, len(runs), *best, *digests, runs, *text))
    return rows


def _find(least: int, keep_text: bool):
    schema = pa.schema(COLUMNS + [("collapsed_text", pa.string())] * keep_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = string_parts(batch.column(1))
            for first, last in pieces(offsets):
                # bytes.split cuts at the same six ASCII characters as the pattern of words.
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(first, last)]
                rows = _described(ids[first:last], texts, least, keep_text)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def collapse_periodic_runs(
    docs: DataFrame,
    least: int = 12,
    keep_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Periodic runs of every whole text, and the text with each run cut to its first period.

    Words stand between ASCII white space. A run is a stretch of words with smallest period q and at least
    ``least`` and 2q words that no neighbouring word extends under that period. A word goes if some run holds
    it behind that run's first q words. Returns doc_id, n_words, n_runs, the longest run (start, length,
    period, exponent_milli; ties to the smallest start, then period), runs_sha256 (``start,length,period`` and
    a line break per run), collapsed_sha256, the list ``runs`` and, if asked for, collapsed_text.

    Texts are worked on where they lie, some megabytes at a time, a longer text by itself; nothing is
    shuffled. Null and empty texts have no words: no run, nulls for the longest, digests of nothing. Rows
    without id and repeated rows are treated each by itself. Other columns are ignored. An empty table gives
    an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_find(least, keep_text), RESULT_SQL + ", collapsed_text string" * keep_text)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, about a tenth of them made periodic from some word on, as their id's checksum says.

    h = crc32(decimal id), g = h // 10: if 10 divides h, words from a = g % n on repeat with period
    p = 1 + (n - a) // (3 + g % 8). Texts with null or no words, and rows without id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    staged = docs.withColumn("__h", h).withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    n, g = F.size("__w").cast("long"), F.floor(F.col("__h") / 10)
    staged = staged.withColumn("__a", F.when(n > 0, g % n))
    staged = staged.withColumn("__p", F.lit(1) + F.floor((n - F.col("__a")) / (F.lit(3) + g % 8)))
    from_word = F.col("__a")
    copied = F.transform(
        "__w",
        lambda w, i: F.when(i < from_word, w).otherwise(
            F.get("__w", (from_word + (i - from_word) % F.col("__p")).cast("int"))
        ),
    )
    planted = F.array_join(copied, " ")
    text = F.when(F.col("__a").isNotNull(), planted).otherwise(F.col(text_col))
    return staged.withColumn(text_col, text).drop("__h", "__w", "__a", "__p")
