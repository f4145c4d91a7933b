import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from common import SMALL, SPACES, empty, hard, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm.periodic import collapse_periodic_runs, periodic_runs, with_planted_runs


def brute(words, least):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((a, b - a, p) for (a, b), p in found.items())


def listed(words, least):
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    got = periodic_runs(np.array([numbers[w] for w in words], np.int64), least)
    return list(zip(*(x.tolist() for x in got)))


def sorted_runs(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60), st.integers(2, 12))
def test_two_letters(words, least):
    assert listed(words, least) == sorted_runs(brute(words, least))


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_runs(seed):
    rng = random.Random(seed)
    words = [rng.randrange(3) for _ in range(rng.randint(1, 6))]
    while len(words) < 400:
        piece = words[rng.randrange(len(words)) :][: rng.randint(1, 90)]
        words += (piece * rng.randint(1, 4))[: rng.randint(1, 200)] + [rng.randrange(3)] * rng.randint(0, 3)
    for least in (2, 12):
        assert listed(words, least) == sorted_runs(brute(words, least))


def test_all_odd_periods_around_a_turn():
    words = [0, 1] * 20 + [1, 0] * 20
    assert listed(words, 2) == sorted_runs(brute(words, 2))
    assert len(listed(words, 2)) > 18


def expected(doc_id, text, least=12):
    words = re.findall(SPACES, text or "")
    runs = sorted_runs(brute(words, least))
    gone = {j for s, n, p in runs for j in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for j, w in enumerate(words) if j not in gone)
    return (
        doc_id, len(words), len(runs), *top, 1000 * top[1] // top[2] if runs else None,
        hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept,
    )


def planted(doc_id, text):
    words = re.findall(SPACES, text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[a + (i - a) % p] if i >= a else words[i] for i in range(n))


NAMES = (
    "doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
    "collapsed_text",
)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    short = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 12_000]
    assert len(short) > 150
    df = spark.createDataFrame(short, "doc_id long, text string").repartition(5)
    got = rows_of(collapse_periodic_runs(with_planted_runs(df), keep_text=True), *NAMES)
    want = sorted((expected(d, planted(d, t)) for d, t in short), key=repr)
    assert got == want
    assert sum(r[2] for r in want) > 15


def test_registered_query_covers_all_rows(spark):
    from flowlens.llm.queries import QUERIES

    got = QUERIES["op13_periodic_runs"](spark, SMALL)
    assert got.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert set(NAMES[:-1]) <= set(got.columns)


def test_hard_rows(spark):
    got = collapse_periodic_runs(hard(spark), keep_text=True)
    want = []
    for r in hard(spark).collect():
        if r["doc_id"] in (9, 10):
            words = re.findall(SPACES, r["text"])
            empty_sha = hashlib.sha256(b"").hexdigest()
            own = hashlib.sha256(" ".join(words).encode()).hexdigest()
            want.append((r["doc_id"], len(words), 0, None, None, None, None, empty_sha, own, " ".join(words)))
        else:
            want.append(expected(r["doc_id"], r["text"]))
    assert rows_of(got, *NAMES) == sorted(want, key=repr)
    assert collapse_periodic_runs(empty(spark)).collect() == []
    assert collapse_periodic_runs(with_planted_runs(hard(spark))).count() == hard(spark).count()
    assert with_planted_runs(hard(spark)).columns == hard(spark).columns


@pytest.mark.parametrize(
    "words",
    [[0] * 300_000, [0, 1] * 150_000, list(range(1000)) * 300, [i % 7 for i in range(200_000)] + [9] * 100_000],
)
def test_long_texts_take_little_time(words):
    begin = time.perf_counter()
    periodic_runs(np.array(words, np.int64), 12)
    assert time.perf_counter() - begin < 10


def test_collapsing_keeps_one_period(spark):
    text = "start " + "a b c " * 30 + "end " + "x " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = collapse_periodic_runs(df, keep_text=True).first()
    assert row["collapsed_text"] == "start a b c end x"
    assert [tuple(r) for r in row["runs"]] == [(1, 90, 3), (92, 40, 1)]
