"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A text is cut into sections (ending at blank lines), those into paragraphs (lines), those into
pieces (sentences; long ones every 16 words). A piece's hash is that of its bytes, an inner node's
that of its children's hashes, so equal roots mean equal texts. Two trees are compared from the
roots down: equal nodes are matched whole, and only the branches that differ are opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.shared import ship_with_tasks

ship_with_tasks(__name__)

LONG_SENTENCE = 200  # characters from which a sentence is cut every 16 words
# Characters that decide on a cut where there is no white space, and the distance of cuts on average.
CUT_CONTEXT, CUT_EVERY = 8, 24
BUCKETS_PER_PARTITION = 4


class Node(NamedTuple):
    """Hash, length in code points, children (none for a piece)."""

    digest: bytes
    length: int
    children: tuple


def _pieces(paragraph: str) -> Iterator[str]:
    """Sentences; long ones cut every 16 words, and what is long without white space cut by its content."""
    import re

    begin = 0
    # Only the first of a run of marks begins a match, so junk of marks is scanned once.
    ends = [m.end() for m in re.finditer(r"(?<![.!?])[.!?]++\s++", paragraph)]
    for end in [*ends, len(paragraph)]:
        sentence = paragraph[begin:end]
        begin = end
        if len(sentence) <= LONG_SENTENCE:
            if sentence:
                yield sentence
            continue
        for piece in re.findall(r"\s*+(?:\S++\s*+){1,16}|\s++", sentence):
            if len(piece) <= LONG_SENTENCE:
                yield piece
            else:
                yield from _cut_by_content(piece)


def _cut_by_content(piece: str) -> Iterator[str]:
    """Cuts behind places where a hash of the last few characters says so, some distance apart.

    An edit moves the cuts around it only, so the pieces before and behind stay the same.
    """
    import numpy as np

    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = np.zeros(len(codes), np.uint64)
    for back in range(CUT_CONTEXT):
        mixed[back:] += codes[: len(codes) - back] * np.uint64(pow(0x9E3779B97F4A7C15, back + 1, 1 << 64))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    begin = 0
    for at in (np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(CUT_EVERY) == 0) + 1).tolist():
        if at - begin >= CUT_CONTEXT and at < len(piece):
            yield piece[begin:at]
            begin = at
    yield piece[begin:]


def _inner(kind: bytes, children: list[Node]) -> Node:
    from hashlib import blake2b

    digest = blake2b(kind + b"".join([c.digest for c in children]), digest_size=16).digest()
    return Node(digest, sum(c.length for c in children), tuple(children))


def merkle_tree(text: str) -> Node:
    """Tree of a text: root, sections, paragraphs, pieces. The pieces joined give the text again."""
    import re
    from hashlib import blake2b

    sections, paragraphs = [], []
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        leaves = [Node(blake2b(b"0" + p.encode(), digest_size=16).digest(), len(p), ()) for p in _pieces(line)]
        paragraphs.append(_inner(b"1", leaves))
        if line.isspace():
            sections.append(_inner(b"2", paragraphs))
            paragraphs = []
    if paragraphs:
        sections.append(_inner(b"2", paragraphs))
    return _inner(b"3", sections)


def compare(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Code points in equal branches, and the spans (start, length) of ``a`` that ``b`` lacks.

    Children of differing nodes are matched by hash, level by level; each match is used once.
    """
    level, other = [(0, a)], [b]
    common = 0
    changed: list[tuple[int, int]] = []
    while level:
        have = Counter(n.digest for n in other)
        opened = []
        for start, node in level:
            if have[node.digest]:
                have[node.digest] -= 1
                common += node.length
            elif node.children:
                for child in node.children:
                    opened.append((start, child))
                    start += child.length
            elif node.length:
                changed.append((start, node.length))
        # Counters say how many of each hash are left over on the other side.
        rest = []
        for n in other:
            if have[n.digest]:
                have[n.digest] -= 1
                rest.extend(n.children)
        level, other = opened, rest
    return common, changed


def likeness(a: Node, b: Node) -> float:
    """Share of both texts that lies in equal branches: 1 for equal texts, 0 for nothing in common."""
    total = a.length + b.length
    return 1.0 if a.digest == b.digest else 2 * compare(a, b)[0] / total if total else 0.0


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _routed(bounds: list[int]):
    """Send each document to its bucket, and the first of each bucket also to the bucket before it."""
    starts = np.array(bounds, np.int64)

    def run(batches):
        for batch in batches:
            order = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(starts, order, side="right") - 1
            first = np.flatnonzero(order == starts[bucket])
            rows = np.concatenate([np.arange(len(order)), first])
            into = np.concatenate([bucket, (bucket[first] - 1) % len(starts)])
            tail = np.arange(len(rows)) >= len(order)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(into, pa.int32()), pa.array(tail), *taken.columns], ["bucket", "tail", "place", "doc_id", "text"]
            )

    return run


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk through sorted buckets; each document meets the next one, the last of a bucket its tail."""
    from hashlib import sha256

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    waiting = None  # bucket, doc_id, text, tree
    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text"))
        for bucket, tail, doc_id, text in zip(*columns):
            if waiting is None and tail:
                continue  # a further row under the id of the tail
            text = text or ""
            tree = merkle_tree(text)
            if waiting is not None:
                _, before, own, own_tree = waiting
                edited = edited_text(own, text)
                edited_tree = merkle_tree(edited)
                out.append(
                    (
                        before,
                        len(own),
                        sha256(edited.encode()).hexdigest(),
                        own_tree.digest.hex(),
                        edited_tree.digest.hex(),
                        likeness(own_tree, edited_tree),
                        likeness(own_tree, tree),
                    )
                )
            waiting = None if tail else (bucket, doc_id, text, tree)
        if out:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint (root of the Merkle tree) of every whole text and of its edited text, and their likeness.

    The edited text has its last half replaced from the next document by ascending id; after the
    last comes the first. Returns doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (likeness to the next document's fingerprint).

    A null text counts as empty; an empty text has a root without children and likeness 1 to another
    empty one. Null ids come last, equal ids follow each other in order of their texts. One document
    alone is its own next. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    place = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    base = docs.select(
        place.alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("place", [i / n for i in range(1, n)], 20 * n)
    least, others = base.agg(F.min("place"), cuts).first()
    bounds = sorted({least, *(others or [])}) if least is not None else [0]
    return (
        base.mapInArrow(_routed(bounds), "bucket int, tail boolean, place long, doc_id long, text string")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "tail", "place", "text")
        .mapInArrow(
            _fingerprint,
            "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double",
        )
    )
