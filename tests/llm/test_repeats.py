import hashlib
import random
import re

import pytest
from common import SPACES, empty, hard, rows_of

from flowlens.llm.lists import pack, unpack
from flowlens.llm.repeats import remove_repeats


def brute(rows, window):
    first, out = {}, []
    for doc, text in sorted(rows):
        words = re.findall(SPACES, text or "")
        gone = [False] * len(words)
        fresh = []
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if first.get(run, doc) < doc:
                gone[i : i + window] = [True] * window
            else:
                fresh.append(run)
        for run in fresh:
            first.setdefault(run, doc)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"p{i}_{j}" for j in range(rng.randint(1, 20))] for i in range(6)]
    rows = []
    for doc in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(2000)}" for _ in range(rng.randint(1, 9))]
        rows.append((doc * 3 % 151, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = remove_repeats(df, window, keep_text=True, chunk_chars=500)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == sorted(brute(rows, window), key=repr)
    for row in got.collect():
        assert sum(s["n"] for s in row["spans"]) == row["n_removed"]


def test_packing():
    import numpy as np

    for values in ([], [5], [1, 2, 3 + (1 << 40)], list(range(0, 1 << 20, 7))):
        array = np.array(values, np.uint64)
        assert unpack(pack(array)).tolist() == values


def test_hard_rows(spark):
    got = rows_of(remove_repeats(hard(spark), 3), "doc_id", "n_words", "n_removed")
    # Document 6 stands there twice: both rows lose what document 5 has, and nothing to each other.
    assert [g for g in got if g[0] in (5, 6, 7)] == [(5, 12, 0), (6, 12, 12), (6, 12, 12), (7, 12, 11)]
    assert [g for g in got if g[0] is None] == [(None, 0, 0), (None, 12, 12)]
    assert (9, 30_000, 0) in got and (10, 1, 0) in got and (1, 0, 0) in got
    assert remove_repeats(empty(spark)).collect() == []
