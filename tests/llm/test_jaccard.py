import random
import re
from collections import Counter

import numpy as np
import pytest
from common import SPACES, ascii_lower, empty, hard, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpus_pipeline import drop_near_duplicates
from flowlens.llm import components, jaccard
from flowlens.llm.components import connected_components
from flowlens.llm.jaccard import frequency_class, ngram_jaccard_join, prefix


def brute(rows, size, threshold):
    """doc_id -> (set size, smallest linked id, links) by counting all shared shingles."""
    sets = {}
    for doc, text in rows:
        words = re.findall(SPACES, ascii_lower(text or ""))
        runs = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        sets[doc] = frozenset(runs or ([tuple(words)] if words else []))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, where = Counter(), {}
    for doc in sorted(sets):
        shared = Counter(e for s in sets[doc] for e in where.get(s, ()))
        for s in sets[doc]:
            where.setdefault(s, []).append(doc)
        for other, n in shared.items():
            if 100 * n >= threshold * (len(sets[doc]) + len(sets[other]) - n):
                links[doc] += 1
                links[other] += 1
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
    return sorted((d, len(sets[d]), find(d), links[d]) for d in sets)


def copies(seed, n=120):
    """Originals with near copies of varied distance, exact copies and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 5, 20])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += rng.choices(vocabulary, k=rng.randint(0, 4))
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 12, 20, 60, 150, 400]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,size,threshold", [(1, 3, 90), (2, 5, 80), (3, 1, 70)])
def test_equals_brute_force(spark, monkeypatch, seed, size, threshold):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)  # several blocks per group
    rows = copies(seed)
    got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), size, threshold)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute(rows, size, threshold), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 300), st.integers(50, 99), st.randoms(use_true_random=False))
def test_linked_sets_share_a_prefix_shingle(n, threshold, rng):
    """Whatever the frequency classes, sets that reach the threshold meet."""
    space = np.random.default_rng(rng.randrange(1 << 30))
    base = np.unique(space.integers(0, 1 << 64, n, dtype=np.uint64))
    classes = frequency_class(space.integers(2, 1 << rng.randint(2, 20), len(base)))
    alone = np.zeros(len(base), bool)
    a, b = (rng.randint(0, max(0, len(base) * (110 - threshold) // 100)) for _ in range(2))
    drop = space.permutation(len(base))
    left, right = np.sort(drop[a:]), np.sort(drop[: len(base) - b])
    alone[np.setxor1d(left, right)] = True
    classes = np.where(alone, 0, classes)
    shared = len(np.intersect1d(left, right))
    if len(left) and len(right) and 100 * shared >= threshold * (len(left) + len(right) - shared):
        one, two = (prefix(base[x], classes[x], threshold) for x in (left, right))
        assert np.intersect1d(one, two).size


def test_shared_passages_bring_nothing_together(spark):
    """Documents that share half of their text are in no group, however many there are."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(60)])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(ngram_jaccard_join(df, 5, 80), "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute(rows, 5, 80), key=repr)


def test_many_near_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i % 190] + [f"u{i}"] + words[i % 190 + 1 :])) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = ngram_jaccard_join(df, 3, 90)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute(rows, 3, 90), key=repr)


def test_hard_rows(spark):
    got = rows_of(ngram_jaccard_join(hard(spark), 3, 90), "doc_id", "n_shingles", "component_id", "n_links")
    assert (1, 0, 1, 0) in got and (2, 0, 2, 0) in got and (3, 0, 3, 0) in got and (4, 1, 4, 0) in got
    assert [g for g in got if g[0] in (5, 6, 7)] == [(5, 10, 5, 3), (6, 10, 5, 3), (6, 10, 5, 3), (7, 10, 5, 3)]
    assert sorted(g[1:] for g in got if g[0] is None) == [(0, None, 0), (10, None, 0)]
    assert (9, 29_998, 9, 0) in got and (10, 1, 10, 0) in got
    assert ngram_jaccard_join(empty(spark), 3, 90).collect() == []


def test_texts_under_one_id_are_apart(spark):
    """Each text links and is dropped for itself, whatever else its id names."""
    texts = {c: [f"{c}{i}" for i in range(60)] for c in "xyz"}
    near = {c: " ".join([*w[:-1], "other"]) for c, w in texts.items()}
    rows = [(5, " ".join(texts[c])) for c in "xyz"] + [(3, near["y"]), (9, near["x"]), (9, near["z"]), (7, near["x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = rows_of(ngram_jaccard_join(df, 5, 80).join(df.withColumn("text_key", F.xxhash64("text")), ["doc_id", "text_key"]), "doc_id", "text", "component_id", "n_links")
    component = {"x": 5, "y": 3, "z": 5}
    assert got == sorted(((d, t, component[t[0]], 2 if t[0] == "x" else 1) for d, t in rows), key=repr)
    kept = rows_of(drop_near_duplicates(spark, df, ""), "doc_id", "text")
    assert kept == sorted([(5, rows[0][1]), (5, rows[2][1]), (3, near["y"])], key=repr)


def test_near_copies_under_one_id_leave_one(spark):
    """Of linked texts one stays, also where they share an id, or id and words; what is not linked stays too."""
    words = [f"x{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(f"z{i}" for i in range(40))
    rows = [(5, text), (5, near), (5, text.upper()), (5, other), (5, text), (8, near), (None, text), (6, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_jaccard_join(df, 5, 80).where("representative and doc_id = 5 and n_links > 0").select("text_key").distinct()
    keys = {r["k"] for r in spark.createDataFrame([(t,) for t in (text, near, text.upper())], "t string").select(F.xxhash64("t").alias("k")).collect()}
    assert [r["text_key"] for r in got.collect()] == [min(keys)]
    kept = rows_of(drop_near_duplicates(spark, df, ""), "doc_id", "text")
    linked = [r for r in kept if r[0] == 5 and r[1] != other]
    assert len(linked) == 1 and len(kept) == 5
    assert sorted(map(repr, set(kept) - set(linked))) == sorted(map(repr, {(5, other), (None, text), (6, ""), (6, None)}))


def test_shared_ids_equal_brute_force(spark):
    rows = [((i // 3, i), text) for i, text in copies(4)]
    df = spark.createDataFrame([(doc, text) for (doc, _), text in rows], "doc_id long, text string").repartition(5)
    wanted = [(doc, n, root[0], links) for (doc, _), n, root, links in brute(rows, 3, 90)]
    assert rows_of(ngram_jaccard_join(df, 3, 90), "doc_id", "n_shingles", "component_id", "n_links") == sorted(wanted, key=repr)


@pytest.mark.parametrize("most", [0, 50_000])
def test_no_documents_are_collected(spark, monkeypatch, most):
    rows = copies(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    collected, collect = [], type(df).collect
    with monkeypatch.context() as patch:
        patch.setattr(jaccard, "LOOKUP_ROWS", most)
        patch.setattr(type(df), "collect", lambda self: collected.append(collect(self)) or collected[-1])
        linked = ngram_jaccard_join(df, 3, 90)
    assert max(map(len, collected), default=0) <= 1
    assert rows_of(linked, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute(rows, 3, 90), key=repr)


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "FLUSH_ROWS", 3)
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(40)]
    loose = [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in chain + star + loose]
    rng.shuffle(edges)
    got = dict(rows_of(connected_components(spark.createDataFrame(edges, "a long, b long").repartition(11)), "node", "root"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()
