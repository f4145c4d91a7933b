import random
import re
import zlib
from collections import Counter

import pytest
from common import SMALL, empty, hard, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm.spelling import LEVELS, Trie, _apart_by_one, _levels_of, _spelled, _verified, count_words, spelling_variants

COLUMNS = ("word", "n", "form", "root", "n_near", "form_n")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    forms, out = {}, []
    for w, n in counts.items():
        others = sorted((-m, v) for v, m in counts.items() if near(w, v))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        forms[w] = best[1] if best else None
        out.append([w, n, forms[w], None, len(others), -best[0] if best else None])
    for row in out:
        root = row[0]
        while forms[root] is not None:
            root = forms[root]
        row[3] = root
    return sorted((tuple(r) for r in out), key=repr)


def counted(docs, every, letters=6, least=5):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if every and doc_id is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= letters and n >= least}


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=5), st.text("abé", max_size=5))
def test_verification(a, b):
    if len(b) - len(a) not in (0, 1):
        return
    _, letters = _spelled([a, b])
    got = _verified(letters[:1], letters[1:], _levels_of([a, b])[0][1:] > len(a))
    assert got.tolist() == [near(a, b)] == [_apart_by_one(a, b)]


def test_trie_reaches_all_near_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("eainmzé") for _ in range(rng.randint(3, 5))) for _ in range(600)})
    _, counts = _levels_of(words)
    trie = Trie(words, 0)
    found = set()
    for surplus, deficit in ((1, 1), (1, 0)):
        for rows, leaves in trie.search(counts, surplus, deficit):
            for r, leaf in zip(rows.tolist(), leaves.tolist()):
                for at in range(trie.starts[leaf], trie.starts[leaf + 1]):
                    found.add((words[r], words[trie.order[at]]))
    for a in words:
        for b in words:
            if near(a, b) and len(b) >= len(a):
                assert (a, b) in found
    assert counts.shape[1] == LEVELS and len(found) < len(words) ** 2 / 4


@pytest.mark.parametrize("part_words", [20_000, 3])
def test_equals_brute_force(spark, part_words):
    rng = random.Random(part_words)
    stems = ["".join(rng.choice("abcdeinrtéØ") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    counts = {}
    for stem in stems + ["x" * 70, "y" * 63, "z" * 64]:
        counts[stem] = rng.choice([5, 25, 625, 3000])
        for _ in range(rng.randint(0, 8)):
            w = rng.choice([stem, *list(counts)[-3:]])
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeéz") + w[i:], w[:i] + rng.choice("aeoz") + w[i + 1 :]])
            counts.setdefault(w, rng.choice([1, 2, 5, 24, 25, 125, 625]))
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(7)
    got = rows_of(spelling_variants(df, part_words=part_words), *COLUMNS)
    want = brute(counts)
    assert got == want
    assert sum(r[2] is not None for r in want) > 50 and any(r[3] not in (r[0], r[2]) for r in want)


def test_words_of_one_description(spark):
    """All words have the same counts, so the leaves are compared in blocks."""
    from itertools import permutations

    counts = {"".join(p): 1 + i % 7 for i, p in enumerate(permutations("abcdef"))}
    counts |= {"abcdefa": 50, "abcdff": 50}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling_variants(df, part_words=10), *COLUMNS) == brute(counts)


def test_counting_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for every in (None, 7, 199):
        assert dict(rows_of(count_words(df, slip_every=every), "word", "n")) == counted(docs, every)


def test_hard_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in hard(spark).collect()]
    got = count_words(hard(spark), least_letters=0, least_count=1, slip_every=3)
    assert dict(rows_of(got, "word", "n")) == counted(docs, 3, 0, 1)
    assert count_words(empty(spark)).collect() == []
    assert spelling_variants(count_words(empty(spark))).collect() == []
    rows = [("abc", 1), ("abc", 4), ("abd", 25), (None, 5), ("abe", None), ("", 2), ("a", 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "word string, n long, form string, root string")
    assert rows_of(spelling_variants(df), *COLUMNS) == brute({"abc": 5, "abd": 25, "": 2, "a": 2})
