import zlib
from collections import Counter, defaultdict

import pytest
from common import SMALL, empty, hard
from hypothesis import given
from hypothesis import strategies as st

from flowlens.llm import sharding
from flowlens.llm.sharding import longest_first, shard_documents


def check(rows, got, shards):
    """Sizes, checksums, gapless slots, and equal texts in one shard; returns the loads."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    slots, load, home = defaultdict(list), Counter({s: 0 for s in range(shards)}), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert home.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) == set(range(shards))
    return load


@given(st.lists(st.integers(1, 1000), max_size=200), st.integers(1, 12))
def test_schedule_is_longest_first(sizes, shards):
    items = [(f"i{k:03d}", s) for k, s in enumerate(sizes)]
    got = dict(longest_first(items, shards))
    loads = [0] * shards
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        best = min(range(shards), key=lambda s: (loads[s], s))
        assert got[name] == best
        loads[best] += size
    # The schedule's known bound: at most 4/3 of the best possible largest load.
    if sizes:
        assert max(loads) <= 4 / 3 * max(max(sizes), sum(sizes) / shards) + max(sizes) / 3


def test_shards_of_the_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = shard_documents(docs, 7).collect()
    load = check(rows, got, 7)
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 7
    again = shard_documents(docs.repartition(5), 7).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_bundles_and_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUNDLES", 50)
    monkeypatch.setattr(sharding, "LARGE", 4)
    rows = [(i, f"text {i} " + "x" * (i % 40)) for i in range(2000)] + [(10_000 + i, "copy") for i in range(700)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 4).collect()
    load = check(rows, got, 4)
    assert max(load.values()) < 1.1 * sum(load.values()) / 4


def test_hard_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in hard(spark).collect()]
    check(rows, shard_documents(hard(spark), 3).collect(), 3)
    assert shard_documents(empty(spark), 3).collect() == []
