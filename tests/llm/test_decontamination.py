import hashlib
import random
import re

import pytest
from common import ascii_lower, empty, hard, rows_of

from flowlens.llm import decontamination
from flowlens.llm.decontamination import PositionalIndex

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return re.findall(WORD, ascii_lower(text or ""))


def brute(docs, items, size):
    phrases = []
    for item, text in items:
        w = words(text)
        phrases += [(item, tuple(w[i : i + size])) for i in range(max(1, len(w) - size + 1))] if w else []
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, phrase in phrases:
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def table(spark, rows, id_col="doc_id"):
    return spark.createDataFrame(rows, f"{id_col} long, text string")


@pytest.mark.parametrize("size,rows", [(1, 50_000), (3, 50_000), (10, 50_000), (3, 5), (10, 5), (3, 0)])
def test_equals_brute_force(spark, monkeypatch, size, rows):
    """Few terms, of which a broadcast holds all, and more than it may hold."""
    monkeypatch.setattr(decontamination, "TERM_ROWS", rows)
    rng = random.Random(size)
    vocabulary = ["the", "of", "and", "The", "OF", "été", "Été", "ÉTÉ", "x1", "7", "naïve", "end"] + [f"r{i}" for i in range(30)]
    join = lambda ws: "".join(w + rng.choice([" ", ", ", "-", "_", "\n", "'"]) for w in ws)
    items = [(i, join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(40)]
    docs = []
    for d in range(80):
        parts = [rng.choices(vocabulary, k=rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts.append(words(rng.choice(items)[1]))
            parts.append(rng.choices(vocabulary, k=rng.randint(0, 5)))
        docs.append((d, join([w for p in parts for w in p])))
    index = PositionalIndex(table(spark, docs).repartition(4), table(spark, items, "item_id"), size)
    assert rows_of(index.report(), *COLUMNS) == brute(docs, items, size)
    # The index holds the occurrences of the terms that the phrases are looked up by, and no others.
    terms = {r["anchor"] for r in index.anchors.collect()}
    assert index.postings.count() == sum(w in terms for _, text in docs for w in words(text))


def test_proximity(spark):
    items = [(1, "alpha beta gamma delta")]
    docs = [
        (1, "x alpha beta gamma delta y"),
        (2, "x alpha beta inserted gamma delta y"),
        (3, "beta alpha gamma delta"),
        (4, "alpha " + "pad " * 30 + "beta gamma delta"),
        (5, "alpha beta gamma"),
    ]
    index = PositionalIndex(table(spark, docs), table(spark, items, "item_id"), 10)
    assert [r["doc_id"] for r in index.report().where("contaminated").collect()] == [1]
    assert sorted(r["doc_id"] for r in index.report(slop=2).where("contaminated").collect()) == [1, 2, 3]


def test_hard_rows(spark):
    items = table(spark, [(1, "three FOUR five"), (1, "three FOUR five"), (2, None), (3, ""), (4, "?!"), (None, "eleven twelve"), (10, "seven")], "item_id")
    rows = [(r["doc_id"], r["text"]) for r in hard(spark).collect()]
    got = rows_of(PositionalIndex(hard(spark), items).report(), *COLUMNS)
    assert [(g[0], g[1]) for g in got] == [(e[0], e[1]) for e in brute(rows, [], 10)]
    digest = hashlib.sha256(b"1,10").hexdigest()
    assert {g[2:] for g in got if g[0] in (5, 6, 7) or g[0] is None and g[1]} == {(6, 2, digest, True)}
    assert all(not g[5] for g in got if g[0] in (1, 2, 3, 4, 8, 9, 10))
    clean = PositionalIndex(hard(spark), empty(spark).withColumnRenamed("doc_id", "item_id")).report()
    assert clean.count() == 13 and clean.where("contaminated").isEmpty()
    assert PositionalIndex(empty(spark), items).report().collect() == []
