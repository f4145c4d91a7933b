"""N-gram Jaccard join: exact links between documents whose shingle sets overlap enough.

The document by n-gram incidence matrix is multiplied with its transpose block by block. Columns are
counted first: how many distinct sets have each shingle. Sets that reach the threshold share at least
that part of either one, so one of the rarest shingles of a set, as many as may differ and one more,
is in every set linked with it; and a set too few of whose shingles are in other sets has no link at
all. Sets that share such a shingle form groups, so passages that very many documents share bring
none together unless a document consists of little else. Each group's rows are cut into blocks of
bounded size, every pair of blocks is one dense product over the columns that at least two rows have,
and overlap counts below the bound that the two sizes give are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.components import connected_components, smallest_labels
from flowlens.llm.hashing import WHITESPACE, byte_codes, mix, pieces, string_parts, window_hashes, word_hashes
from flowlens.llm.lists import CHUNK_CHARS, QUESTION, QUESTION_SQL, RANGE_CHARS, Distinct, merged, pack, slices
from flowlens.operators.shared import LOOKUP_ROWS, ship_with_tasks, written_table

for _module in (__name__, "flowlens.llm.hashing", "flowlens.llm.lists"):
    ship_with_tasks(_module)

BLOCK_ROWS = 256
BLOCK_SHINGLES = 1 << 19
COLUMNS = 4096


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one shingle if there are fewer."""
    codes = byte_codes(WHITESPACE, lower=True)
    data, offsets = string_parts(column)
    for first, last in pieces(offsets):
        part = data[offsets[first] : offsets[last]]
        words, firsts = word_hashes(part, offsets[first : last + 1] - offsets[first], codes)
        windows = window_hashes(words, size)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1])
            elif b > a:
                yield mix(window_hashes(words[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _describe(size: int):
    def run(batches):
        for batch in batches:
            counts, keys = [], []
            for shingles in shingle_sets(batch.column(1), size):
                counts.append(len(shingles))
                keys.append(set_key(shingles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key"],
            )

    return run


FLUSH_TOKENS = 2_000_000
ANSWER = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("classes", pa.binary())])
MEETING = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("peer", pa.int64())])


def _chosen(table: pa.Table, docs: set, size: int) -> tuple[list[int], list[np.ndarray]]:
    """Rows of a chunk under the id of a document that stands for a class, with their shingles."""
    ids = table.column("doc_id").to_pylist()
    mine = np.flatnonzero(np.fromiter((i in docs for i in ids), bool, len(ids)))
    rows = table.take(pa.array(mine))
    return rows.column("doc_id").to_pylist(), list(shingle_sets(rows.column("text"), size))


def _listed(sets: list[np.ndarray]) -> Distinct:
    """All shingles of a chunk by the upper 48 bits of their hash."""
    values = np.concatenate(sets) >> np.uint64(16) if sets else np.zeros(0, np.uint64)
    return Distinct(values, np.repeat(np.arange(len(sets)), [len(s) for s in sets]))


def _ask(size: int, ranges: int):
    """Every distinct shingle of a chunk; marks: how many of its sets have it."""

    def run(table: pa.Table, members: pa.Table) -> pa.Table:
        if not table.num_rows or not members.num_rows:
            return QUESTION.empty_table()
        _, sets = _chosen(table, set(members.column("doc_id").to_pylist()), size)
        found = _listed(sets)
        rows = [
            (i, pack(found.values[a:b]), np.minimum(found.counts[a:b], 65_535).astype(np.uint16).tobytes())
            for i, a, b in slices(found.values, ranges, 48)
        ]
        number = table.column("chunk")[0].as_py()
        parts = [[r[0] for r in rows], [number] * len(rows), [r[1] for r in rows], [r[2] for r in rows]]
        return pa.table(parts, schema=QUESTION)

    return run


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0 for a shingle of one set; else four classes for each doubling of the number of sets."""
    return np.where(counts < 2, 0, np.minimum(1 + np.floor(4 * np.log2(np.maximum(counts, 1))), 255)).astype(np.uint8)


def _count(table: pa.Table) -> pa.Table:
    """Frequency class of each shingle in each chunk's list, in the list's order."""
    chunks, lists, order, starts, sizes = merged(table)
    counts = np.concatenate([np.frombuffer(raw, np.uint16) for raw in table.column("marks").to_pylist()]).astype(np.int64)
    classes = np.empty(len(order), np.uint8)
    classes[order] = np.repeat(frequency_class(np.add.reduceat(counts[order], starts)), sizes)
    ends = np.cumsum([len(x) for x in lists])
    parts = [classes[e - len(x) : e].tobytes() for e, x in zip(ends, lists)]
    return pa.table([chunks, table.column("range").to_pylist(), parts], schema=ANSWER)


def prefix(shingles: np.ndarray, classes: np.ndarray, threshold: int) -> np.ndarray:
    """The rarest shingles of a set, of which every set that reaches the threshold with it has one too.

    Shingles are ordered by frequency class and hash. Linked sets share at least threshold % of each,
    so their first common shingle lies that early in both. Shingles of no other set are left out.
    """
    need = -(-threshold * len(shingles) // 100)
    if np.count_nonzero(classes) < need:
        return shingles[:0]
    first = np.lexsort((shingles, classes))[: len(shingles) - need + 1]
    return shingles[first[classes[first] > 0]]


def _meet(size: int, threshold: int):
    """Rows (token, peer): each prefix shingle once with the smallest class that reaches it here;
    rows (node, peer): classes that already met here."""

    def flush(ids: list[int], held: list[np.ndarray]) -> list[np.ndarray]:
        nodes, place = np.unique(np.array(ids, np.int64), return_inverse=True)
        owner, marks = np.repeat(place, [len(x) for x in held]), np.concatenate(held)
        label = smallest_labels(len(nodes), owner, marks)
        once, at = np.unique(marks, return_index=True)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        token = pa.concat_arrays([pa.array(once.view(np.int64)), pa.nulls(len(moved), pa.int64())])
        node = pa.concat_arrays([pa.nulls(len(once), pa.int64()), pa.array(nodes[moved])])
        return [token, node, pa.concat_arrays([pa.array(nodes[label[owner[at]]]), pa.array(nodes[label[moved]])])]

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return MEETING.empty_table()
        rows = zip(*(told.column(c).to_pylist() for c in ("doc_id", "set_key", "node")))
        members = {(doc, key): node for doc, key, node in rows if node is not None}
        answers = [(r, c) for r, c in zip(told.column("range").to_pylist(), told.column("classes").to_pylist()) if c is not None]
        ids, sets = _chosen(table, {doc for doc, _ in members}, size)
        found = _listed(sets)
        classes = np.frombuffer(b"".join(c for _, c in sorted(answers)), np.uint8)
        of = np.empty(len(found.order), np.uint8)
        of[found.order] = np.repeat(classes, found.counts)
        held, out, count, at = ([], []), [], 0, 0
        for doc, shingles in zip(ids, sets):
            mine = of[at : at + len(shingles)]
            at += len(shingles)
            tokens = prefix(shingles, mine, threshold)
            node = members.get((doc, set_key(shingles))) if len(tokens) else None
            if node is not None:  # else another text under the same doc_id
                held[0].append(node)
                held[1].append(tokens)
                count += len(tokens)
            if count >= FLUSH_TOKENS:
                out.append(pa.table(flush(*held), schema=MEETING))
                held, count = ([], []), 0
        if held[0]:
            out.append(pa.table(flush(*held), schema=MEETING))
        return pa.concat_tables(out) if out else MEETING.empty_table()

    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared shingles of each left and right set: incidence matrix times its transpose, in column blocks."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, columns, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = often > 1
    number = np.cumsum(useful) - 1
    keep = useful[columns]
    rows, columns = rows[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    total = np.zeros((len(left), len(right)), np.float64)
    n = int(useful.sum())
    for low in range(0, n, COLUMNS):
        a, b = np.searchsorted(columns, [low, low + COLUMNS])
        dense = np.zeros((len(sets), min(COLUMNS, n - low)), np.float32)
        dense[rows[a:b], columns[a:b] - low] = 1
        total += dense[left] @ dense[right].T
    return total


def _multiply(size: int, threshold: int):
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("linked", pa.int64())])

    def run(table):
        seen, sets, nodes, copies, blocks = set(), [], [], [], []
        rows = zip(*(table.column(c).to_pylist() for c in ("node", "set_key", "copies", "block")))
        for (node, key, count, block), shingles in zip(rows, shingle_sets(table.column("text"), size)):
            if key in seen or set_key(shingles) != key:
                continue  # a repeated row, or another text under the same doc_id
            seen.add(key)
            sets.append(shingles), nodes.append(node), copies.append(count), blocks.append(block)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        blocks, nodes, copies = (np.array(x, np.int64) for x in (blocks, nodes, copies))
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        if len(sets) < 2 or not len(left) or not len(right):
            return schema.empty_table()
        sizes = np.array([len(s) for s in sets], np.float64)
        a, b = sizes[left][:, None], sizes[right][None, :]
        shared = overlaps(sets, left, right)
        linked = (100 + threshold) * shared >= threshold * (a + b)
        if i == j:
            linked &= ~np.eye(len(left), dtype=bool)
        x, y = np.nonzero(linked)
        if not len(x):
            return schema.empty_table()
        x, y = left[x], right[y]
        label = smallest_labels(len(sets), np.concatenate([x, y]), np.tile(np.arange(len(x)), 2))
        weight = np.zeros(len(sets), np.int64)
        np.add.at(weight, x, copies[y])
        if i != j:
            np.add.at(weight, y, copies[x])
        order = np.unique(np.concatenate([x, y]))
        low = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(low, label[order], nodes[order])
        return pa.table([nodes[order], low[label[order]], weight[order]], schema=schema)

    return run


def ngram_jaccard_join(
    docs: DataFrame, words: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Class and number of links of every document, links being 100 * |A and B| >= threshold * |A or B|.

    A document's set holds the distinct runs of ``words`` words of its whole text (A-Z in lower case,
    words between ASCII white space); with fewer words, the whole sequence is its one element. Returns
    doc_id, text_key (hash of the text), n_shingles, component_id (smallest doc_id reachable by links,
    itself included), n_links (other documents it links with, copies counted) and representative (whether it
    is the one to keep of its component: that of smallest doc_id and, where texts share it, text_key). Sets are
    compared by 64-bit shingle hashes.

    Documents without words (null or empty text) link with nothing. Rows without an id take no part:
    they come back with null component_id and no links. Repeated rows are copies of each other. Of
    rows that share an id but not a text, each counts by its own text. Rows without an id or words are
    representative. Other columns are ignored. An empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written_table(
        base.withColumn("text_key", F.xxhash64("text")).mapInArrow(
            _describe(words), "doc_id long, text_key long, n_shingles long, set_key binary"
        ),
        "shingle-sets",
    )
    # A class of equal sets is a node under a number of its own, as several may have one doc_id.
    classes = written_table(
        sets.where("doc_id is not null and n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("size")
        )
        .withColumn("doc_id", F.col("first.doc_id"))
        .withColumn("node", F.monotonically_increasing_id()),
        "set-classes",
    )
    spark = docs.sparkSession
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chars = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks, ranges = max(least_parts, chars // CHUNK_CHARS), max(least_parts, chars // RANGE_CHARS)
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks).cast("long")).alias("chunk")
    # One shuffle of the texts by chunk serves both the counts and the prefixes.
    dealt = base.where("doc_id is not null").select("doc_id", "text", chunk("doc_id"))
    known = classes.select(chunk("doc_id"), "doc_id", "node", "set_key")
    asked = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_ask(words, ranges), QUESTION_SQL)
    counted = asked.groupBy("range").applyInArrow(_count, "chunk long, range int, classes binary")
    told = known.unionByName(counted, allowMissingColumns=True)
    met = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        _meet(words, threshold), "token long, node long, peer long"
    )
    least = F.min("peer").over(Window.partitionBy("token", "node"))
    edges = met.withColumn("least", least).select(
        F.coalesce("node", "peer").alias("a"), F.col("least").alias("b")
    ).where("a <> b")
    groups = connected_components(written_table(edges.distinct(), "candidates"))
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    rows = members.withColumnRenamed("root", "bunch").join(classes, "node")
    sizes = rows.groupBy(F.col("bunch").alias("whole")).agg(
        F.greatest(
            F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SHINGLES)
        ).cast("long").alias("n_blocks"),
        F.count("*").alias("n_sets"),
    ).where("n_sets > 1")
    blocks = (
        rows.join(sizes, rows["bunch"] == sizes["whole"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")))
        .select("node", F.col("doc_id").alias("of_doc"), "bunch", "set_key", "copies", "block", "n_blocks")
    )
    # Few documents are in a group: a broadcast of counted size spares the shuffle of all texts where they fit.
    blocks = written_table(blocks, "blocks")
    if blocks.count() <= LOOKUP_ROWS:
        blocks = F.broadcast(blocks)
    pairs = (
        base.join(blocks, base["doc_id"] == blocks["of_doc"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .select(
            "node", "set_key", "copies", "block", "text", "bunch",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    found = written_table(
        pairs.groupBy("bunch", "i", "j").applyInArrow(
            _multiply(words, threshold), "node long, root long, linked long"
        ),
        "jaccard-links",
    )
    roots = connected_components(found.select("node", "root"))
    whole = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = whole.join(classes, "node").groupBy("root").agg(F.min("first").alias("least"))
    component = whole.join(least, "root").select("node", "least")
    linked = found.groupBy(F.col("node").alias("of")).agg(F.sum("linked").alias("linked"))
    named = (
        classes.join(component, "node", "left")
        .join(linked, F.col("node") == F.col("of"), "left")
        .select(
            "set_key",
            F.coalesce("least", "first").alias("root"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
        )
    )
    known = F.col("doc_id").isNotNull()
    mine = F.struct("doc_id", "text_key") == F.col("root")
    return sets.join(named, "set_key", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(known, F.when(F.col("n_shingles") > 0, F.col("root.doc_id")).otherwise(F.col("doc_id"))).alias("component_id"),
        F.when(known & (F.col("n_shingles") > 0), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(known & (F.col("n_shingles") > 0), mine).otherwise(F.lit(True)).alias("representative"),
    )
