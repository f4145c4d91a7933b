"""Spelling variants: words one letter apart, found in a trie of letter-group counts.

A word is described by its length and by how often it holds the letters of each group. One inserted letter
raises one count by one; a replaced letter raises one and lowers one, or changes none. So the words near a
word lie in the trie of counts within a budget of one surplus and one deficit. The search goes down the trie
depth first, spending the budget where counts differ, and the words of the leaves it reaches are compared.

The trie is cut into parts that tasks hold. Each word lives in one part, named by its length and first
counts: by as many of them as it takes to leave at most some ten thousand words under the name. The search
for a word begins before the parts are known, spends its budget on the counts of the names, and goes on in
every part it may reach with what is left of the budget. Words search their own length and the next one, so
a deletion is found from the other side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.shared import ship_with_tasks, written_table

ship_with_tasks(__name__)

# Letters counted together, the telling ones first; what is in none is counted last.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "u", "d", "cm", "gp", "bh", "fkqvwxyzj")
LEVELS = len(GROUPS) + 1
# Numbers of leading counts that may name a part of the trie.
DEPTHS = (0, 2, 4, 6, 8, 10, 12, LEVELS)
PART_WORDS = 20_000
# Parts that had to be cut, at most; their names are sent to all tasks.
CUT_PARTS = 20_000
FLUSH_WORDS = 200_000
BLOCK = 4_000
PAIRS = 100_000
LETTERS = "[A-Za-zÀ-ÿ]+"
_LOWER = {c: c + 32 for c in range(65, 91)}


def _count(slip_every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(LETTERS)
        found: Counter[str] = Counter()

        def table():
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for run_, n in Counter(letters.findall(text or "")).items():
                    own[run_.translate(_LOWER)] += n
                seed = crc32(f"{doc_id}:".encode()) if slip_every and doc_id is not None else None
                for word, n in own.items():
                    if seed is not None:
                        h = crc32(word.encode(), seed)
                        if h % slip_every == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    found[word] += n
                if len(found) > FLUSH_WORDS:
                    yield table()
                    found.clear()
        yield table()

    return run


def count_words(
    docs: DataFrame,
    least_letters: int = 6,
    least_count: int = 5,
    slip_every: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of whole texts and how often they stand there: (word, n).

    Words are runs of ASCII and Latin-1 letters, with A-Z lower-cased. With ``slip_every``, the word w of a
    document loses the letter h % length, where h = crc32("<doc_id>:w") is a multiple of ``slip_every``:
    misspellings planted alike in every run. Only words of ``least_letters`` code points and ``least_count``
    occurrences are returned. Null texts have no words; rows without id lose no letters.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_count(slip_every), "word string, n long").where(F.length("word") >= least_letters)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _group_counts(word: Column) -> list[Column]:
    """The counts of all levels, as built-in expressions."""
    counts = [F.length(word) - F.length(F.translate(word, g, "")) for g in GROUPS]
    return [*counts, F.length(F.translate(word, "".join(GROUPS), ""))]


def _levels_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and counts of words (words x levels)."""
    table = np.full(128, LEVELS - 1, np.int64)
    for level, group in enumerate(GROUPS):
        table[[ord(c) for c in group]] = level
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    level = np.where(codes < 128, table[np.minimum(codes, 127)], LEVELS - 1)
    cells = np.repeat(np.arange(len(words)), lengths) * LEVELS + level
    return lengths, np.bincount(cells, minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def _name(length: int, counts) -> str:
    return ",".join(map(str, (length, *counts)))


def _scatter(cut: frozenset[str]):
    """Each word to the part it lives in, and its search to all parts that the budget lets it reach."""
    schema = pa.schema(
        [("part", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("depth", pa.int32()),
         ("surplus", pa.int32()), ("deficit", pa.int32())]
    )
    followers = dict(zip(DEPTHS, DEPTHS[1:]))

    def reached(length: int, counts: list[int], surplus: int, deficit: int) -> Iterator[tuple[str, int, int, int]]:
        open_ = [((), surplus, deficit, 0)]
        while open_:
            path, s, d, stop = open_.pop()
            if len(path) < stop:
                c = counts[len(path)]
                open_.append(((*path, c), s, d, stop))
                if s:
                    open_.append(((*path, c + 1), s - 1, d, stop))
                if d and c:
                    open_.append(((*path, c - 1), s, d - 1, stop))
                continue
            name = _name(length, path)
            if name in cut:
                open_.append((path, s, d, followers[stop]))
            else:
                yield name, stop, s, d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not words:
                continue
            lengths, counts = _levels_of(words)
            block = list(zip(words, ns, lengths.tolist(), counts.tolist()))
            for first in range(0, len(words), BLOCK):
                rows = []
                for word, n, length, own in block[first : first + BLOCK]:
                    for name, depth, _, _ in reached(length, own, 0, 0):
                        rows.append((name, word, n, depth, -1, -1))
                    for name, depth, s, d in reached(length, own, 1, 1):
                        rows.append((name, word, n, depth, s, d))
                    for name, depth, s, d in reached(length + 1, own, 1, 0):
                        rows.append((name, word, n, depth, s, d))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


class Trie:
    """Counts of the words of one part below its name, as sorted child tables per level."""

    def __init__(self, words: list[str], depth: int):
        _, counts = _levels_of(words)
        self.depth = depth
        order = np.lexsort(counts.T[::-1]) if len(words) else np.zeros(0, np.int64)
        self.order = order
        node = np.zeros(len(words), np.int64)
        self.width = int(counts.max(initial=0)) + 2
        self.children: list[np.ndarray] = []
        for level in range(depth, LEVELS):
            edge = node * self.width + counts[order, level]
            fresh = np.append(True, edge[1:] != edge[:-1])[: len(edge)]
            self.children.append(edge[fresh])
            node = np.cumsum(fresh) - 1
        self.starts = np.searchsorted(node, np.arange(int(node.max(initial=-1)) + 2))

    def _child(self, level: int, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        edges = self.children[level - self.depth]
        wanted = node * self.width + count
        at = np.minimum(np.searchsorted(edges, wanted), len(edges) - 1)
        fits = (edges[at] == wanted) & (count >= 0) & (count < self.width)
        return np.where(fits, at, -1)

    def search(self, counts: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first: rows of ``counts`` and the leaves they reach, for every way to spend the budget."""
        if not len(self.order):
            return
        rows = np.arange(len(counts))
        open_ = [(self.depth, surplus, deficit, rows, np.zeros(len(rows), np.int64))]
        while open_:
            level, s, d, rows, node = open_.pop()
            if level == LEVELS:
                yield rows, node
                continue
            own = counts[rows, level]
            for change, after_s, after_d in ((0, s, d), (1, s - 1, d), (-1, s, d - 1)):
                if after_s < 0 or after_d < 0:
                    continue
                child = self._child(level, node, own + change)
                alive = child >= 0
                if alive.any():
                    open_.append((level + 1, after_s, after_d, rows[alive], child[alive]))


def _apart_by_one(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced or inserted."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) > n else i < n and a[i + 1 :] == b[i + 1 :]


WIDTH = 64


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which words have less than ``WIDTH`` letters, and their code points with zeros behind."""
    short = [len(w) < WIDTH and "\0" not in w for w in words]
    letters = np.array([w if s else "" for w, s in zip(words, short)], f"U{WIDTH}")
    return np.array(short), letters.view(np.uint32).reshape(-1, WIDTH)


def _verified(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Rows in which b is a with one letter replaced, or, where b is longer, inserted."""
    differ = a != b
    first = differ.argmax(axis=1)
    behind = np.zeros(b.shape, bool)
    behind[:, :-1] = a[:, :-1] == b[:, 1:]
    behind[:, -1] = True
    behind |= np.arange(b.shape[1]) < first[:, None]
    return np.where(longer, behind.all(axis=1), differ.sum(axis=1) == 1)


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _search_part(table: pa.Table) -> pa.Table:
    """How many near words this part shows each word, and the most frequent of them."""
    surplus = table.column("surplus").to_numpy()
    home = np.flatnonzero(surplus < 0)
    if not len(home) or len(home) == len(surplus):
        return NEAR.empty_table()
    words = table.column("word").to_pylist()
    ns = table.column("n").to_numpy()
    deficit = table.column("deficit").to_numpy()
    spelled = sorted(set(words))
    number = {w: i for i, w in enumerate(spelled)}
    who = np.array([number[w] for w in words], np.int64)
    often = np.zeros(len(spelled), np.int64)
    often[who] = ns
    lives = who[home]
    trie = Trie([words[i] for i in home.tolist()], int(table.column("depth")[0].as_py()))
    plain, letters = _spelled(spelled)
    lengths, counts = _levels_of(spelled)
    left, right = [], []
    for s, d in ((1, 1), (1, 0), (0, 1), (0, 0)):
        asking = who[(surplus == s) & (deficit == d)]
        for first in range(0, len(asking), BLOCK):
            block = asking[first : first + BLOCK]
            for rows, leaves in trie.search(counts[block], s, d):
                sizes = trie.starts[leaves + 1] - trie.starts[leaves]
                ends = np.cumsum(sizes)
                for a, b in _spans(ends):
                    size = sizes[a:b]
                    at = np.arange(int(size.sum())) + np.repeat(trie.starts[leaves[a:b]] - ends[a:b] + size + (ends[a] - size[0]), size)
                    one, other = np.repeat(block[rows[a:b]], size), lives[trie.order[at]]
                    grown = lengths[other] - lengths[one]
                    short = plain[one] & plain[other]
                    near = np.zeros(len(one), bool)
                    near[short] = _verified(letters[one[short]], letters[other[short]], grown[short] == 1)
                    for i in np.flatnonzero(~short).tolist():
                        near[i] = _apart_by_one(spelled[one[i]], spelled[other[i]])
                    one, other, grown = one[near], other[near], grown[near]
                    left.append(np.concatenate([one, other[grown == 1]]))
                    right.append(np.concatenate([other, one[grown == 1]]))
    if not left:
        return NEAR.empty_table()
    one, other = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((other, -often[other], one))
    one, other = one[order], other[order]
    first = np.flatnonzero(np.append(True, one[1:] != one[:-1])[: len(one)])
    sizes = np.diff(np.append(first, len(one)))
    return pa.table(
        [
            [spelled[i] for i in one[first].tolist()],
            sizes,
            often[other[first]],
            [spelled[i] for i in other[first].tolist()],
        ],
        schema=NEAR,
    )


def _spans(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of leaves with some hundred thousand words; a larger leaf is one range."""
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + PAIRS, side="right")), first + 1)
        yield first, last
        first = last


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Words that have near words, how many, and the most frequent (ties: the first in code-point order).

    ``words`` (word, n) has each word once. Near words differ by one inserted, deleted or replaced code point.
    Returns (word, n_near, best, best_n). A part of the trie holds ``part_words`` words, or a
    ``CUT_PARTS``-th of all where that is more.
    """
    counts = _group_counts(F.col("word"))
    paths = words.select(F.concat_ws(",", F.length("word"), *counts).alias("path"))
    paths = paths.groupBy("path").agg(F.count("*").alias("n"))
    total = words.count()
    limit = max(part_words, len(DEPTHS) * total // CUT_PARTS)
    cut: set[str] = set()
    for depth in DEPTHS[:-1]:
        name = F.substring_index("path", ",", depth + 1).alias("name")
        large = paths.groupBy(name).agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
        if not large:
            break
        cut.update(r["name"] for r in large)
    scattered = words.select("word", "n").mapInArrow(
        _scatter(frozenset(cut)), "part string, word string, n long, depth int, surplus int, deficit int"
    )
    found = scattered.groupBy("part").applyInArrow(_search_part, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.word").alias("best"), (-F.col("best.n")).alias("best_n"))


def spelling_variants(words: DataFrame, ratio: int = 5, part_words: int = PART_WORDS) -> DataFrame:
    """The accepted spelling of each word: its near word of largest n, if that is ``ratio`` times its own n.

    ``words`` has word and n; other columns are ignored, rows of one word are added up, null words and null
    counts left out. Returns word, n, form (the near word, else null), root (the last word reached by
    following forms, the word itself if it has none), n_near (number of near words) and form_n (n of the
    form, else null). Ties go to the first word in code-point order. Counts grow by ``ratio`` (above 1) along
    forms, so chains end, after a number of steps that grows with the logarithm of the counts; roots are found by
    doubling the steps. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    given = words.where(F.col("word").isNotNull() & F.col("n").isNotNull())
    given = given.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum(F.col("n").cast("long")).alias("n"))
    given = written_table(given, "spelling-words")
    near = near_words(given, part_words)
    accepted = F.col("best_n") >= ratio * F.col("n")
    judged = given.join(near, "word", "left").select(
        "word",
        "n",
        F.when(accepted, F.col("best")).alias("form"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(accepted, F.col("best_n")).alias("form_n"),
    )
    judged = written_table(judged, "spelling-forms")
    roots = judged.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(further, "root", "left")
        moved = moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written_table(moved, "spelling-roots")
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    return judged.join(roots, "word", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n"
    )
