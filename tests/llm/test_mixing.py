import re
from collections import Counter

import pytest
from common import SMALL, SPACES, empty, hard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.llm.mixing import Mix, permuted, source_targets

WEIGHTS = (3, 1, 2)


def brute_targets(sizes, share=1.5, most=2.0):
    """Deal by weight, cut at the limit, deal the excess again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        heavy = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / heavy for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "a", "B", "é", "z", "", "src10", "src9"]), st.integers(0, 500), min_size=1))
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(rows, WEIGHTS, 1.5, 2.0).collect()}
    expected = brute_targets(sizes)
    assert got.keys() == expected.keys()
    for s in got:
        assert got[s] == pytest.approx(expected[s], abs=1e-6)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit("x")).alias("to")).collect()
    assert sorted(r["to"] for r in rows) == list(range(n))
    if n == 1000:
        assert sum(r["to"] == r["id"] for r in rows) < 10
        assert sum(abs(a["to"] - b["to"]) == 1 for a, b in zip(rows, rows[1:])) < 20


def test_mix_of_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    mix = Mix(docs, block_words=16)
    taken = {r["doc_id"]: r for r in mix.taken().collect()}
    size = {d: len(re.findall(SPACES, r["text"] or "")) for d, r in rows.items()}
    sums = Counter()
    for d, r in rows.items():
        sums[r["source"]] += size[d]
    target, got = brute_targets(sums), Counter()
    for d, r in taken.items():
        source = rows[d]["source"]
        assert (r["size"], r["source_size"], r["source"]) == (size[d], sums[source], source)
        assert r["target"] == pytest.approx(target[source]) and 0 <= r["taken"] <= 2 * size[d]
        got[source] += r["taken"]
    assert len(taken) == len(rows)
    for source in sums:
        assert got[source] == pytest.approx(target[source], abs=2 * 16)

    slots = mix.slots().collect()
    assert sorted(s["position"] for s in slots) == list(range(mix.n_slots))
    assert all(n == 1 for n in Counter((s["rank"], s["turn"], s["block"]) for s in slots).values())

    mixed = mix.documents().collect()
    words = Counter()
    for r in mixed:
        own = re.findall(SPACES, rows[r["doc_id"]]["text"])
        part = re.findall(SPACES, r["text"])
        assert r["source"] == rows[r["doc_id"]]["source"] and len(part) <= len(own)
        words[r["doc_id"]] += len(part)
    assert all(words[d] == r["taken"] for d, r in taken.items())

    again = Mix(docs.repartition(7), block_words=16).taken()
    assert {r["doc_id"]: r["taken"] for r in again.collect()} == {d: r["taken"] for d, r in taken.items()}


def test_hard_rows(spark):
    mix = Mix(hard(spark), block_words=4)
    got = mix.taken().collect()
    assert len(got) == 13 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    sums = Counter()
    for r in got:
        sums[r["source"]] += r["size"]
    for source, target in brute_targets(sums).items():
        assert sum(r["taken"] for r in got if r["source"] == source) == pytest.approx(target, abs=8)
    out = mix.documents()
    assert out.columns == hard(spark).columns and sum(len(re.findall(SPACES, r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)
    nothing = Mix(empty(spark))
    assert nothing.taken().collect() == [] and nothing.documents().collect() == []


def test_one_source_with_nearly_all_words(spark):
    rows = [(i, " ".join(["w"] * 50), "big" if i % 20 else "small") for i in range(600)]
    got = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8).taken().collect()
    target = brute_targets(Counter({"big": 570 * 50, "small": 30 * 50}))
    for s in target:
        assert sum(r["taken"] for r in got if r["source"] == s) == pytest.approx(target[s], abs=16)


@pytest.mark.parametrize("n", [1, 2, 9, 200])
def test_inverse_permutation(spark, n):
    size, key = F.lit(n).cast("long"), (F.lit(5), F.lit("k"))
    there = spark.range(n).select("id", permuted(F.col("id"), size, *key).alias("to"))
    assert there.where(permuted(F.col("to"), size, *key, inverse=True) != F.col("id")).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_small_sources_meet_their_targets(spark, seed):
    """Sources of 1 to 1,000 words, most less than a few blocks long: each within a word of its target."""
    import random

    rng = random.Random(seed)
    rows = []
    for s in range(12):
        left = rng.choice([1, 2, 50, 127, 128, 129, 130, 390, 1000])
        while left:
            n = min(left, rng.randint(1, 200))
            rows.append((len(rows), " ".join(["w"] * n), f"s{s:02}"))
            left -= n
    sums = Counter()
    for _, text, source in rows:
        sums[source] += len(text.split())
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_blocks=4)
    got = Counter()
    for r in mix.taken().collect():
        got[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for source, target in brute_targets(sums).items():
        assert abs(got[source] - target) <= 1


def test_taken_and_shards_follow_from_the_drawn_counts(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), "abc"[i % 3]) for i in range(120)]
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8, shard_blocks=50)
    counts, sources = mix.counts.collect(), {r["rank"]: r for r in mix.sources.collect()}
    per_source, per_shard = Counter(), Counter()
    for r in counts:
        per_source[r["rank"]] += r["n"]
        per_shard[r["shard"]] += r["n"]
    assert per_source == {k: r["n_slots"] for k, r in sources.items()}
    assert all(per_shard[s] == 50 for s in list(range(max(per_shard)))) and len(per_shard) > 5
    assert len({r["n"] for r in counts}) > 3
    # By brute force: every word of each source, counted by the slots that use it.
    uses: dict = {}
    for r in mix.slots().collect():
        for word in range(r["block"] * 8, r["block"] * 8 + r["use"]):
            uses.setdefault((r["rank"], word), []).append(r["shard"])
    placed = mix.placed().collect()
    got = {r["doc_id"]: (r["taken"], r["shards"]) for r in mix.taken().collect()}
    for r in placed:
        shards = [s for w in range(r["start"], r["start"] + r["size"]) for s in uses.get((r["rank"], w), [])]
        assert got[r["doc_id"]] == (len(shards), sorted(set(shards)))
    slots = Counter((r["shard"], r["rank"]) for r in mix.slots().collect())
    assert slots == {(r["shard"], r["rank"]): r["n"] for r in counts}
