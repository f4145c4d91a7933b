import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from common import empty, hard
from pyspark.sql import functions as F

from flowlens.llm import resampling
from flowlens.llm.resampling import importance_resample, kth_largest


def corpus(seed=3, n=3000):
    """Prose; one text in seven holds a few abusive words, one in nine is symbols or repeats."""
    rng = random.Random(seed)
    prose = [f"{a}{b}" for a in ("con", "per", "tra", "mon", "sel") for b in ("form", "dict", "vail", "rent", "cede", "port")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(prose, k=rng.randint(30, 200))
        toxic, junk = i % 7 == 0, i % 9 == 0
        if toxic:
            for _ in range(rng.randint(3, 8)):
                words[rng.randrange(len(words))] = rng.choice(["vilea", "vileb", "vilec"])
        if junk:
            words = [w + "%%%" for w in words] if i % 2 else [words[0]] * 60
        rows.append((i, " ".join(words)))
        if rng.random() < 0.4:
            labels.append((i, not toxic and not junk))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, target boolean")
    got = {r["doc_id"]: r["kept"] for r in importance_resample(docs, known).collect()}
    seen = {d for d, _ in labels}
    fresh = [i for i, _ in rows if i not in seen]
    good = [i for i in fresh if i % 7 and i % 9]
    bad = [i for i in fresh if not (i % 7 and i % 9)]
    assert sum(got[i] for i in good) / len(good) > 0.97
    assert sum(not got[i] for i in bad) / len(bad) > 0.95
    share = sum(t for _, t in labels) / len(labels)
    assert sum(got.values()) == pytest.approx(share * len(rows), abs=1)


def test_the_sample_follows_the_weights(spark):
    """Without a telling feature all documents are alike and the noise alone decides."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    known = spark.createDataFrame([(1, True), (2, True)], "doc_id long, target boolean")
    picks = [{r["doc_id"] for r in importance_resample(docs, known, keep=0.25, seed=s).where("kept").collect()} for s in (1, 1, 2)]
    assert len(picks[0]) == 500 and picks[0] == picks[1] and 80 < len(picks[0] & picks[2]) < 180


def test_weights_and_sample_equal_brute_force(spark):
    """Both models counted in plain Python from each text's features, weights summed, noise added, all sorted."""
    rows, labels = corpus(seed=8, n=400)
    rows += [(1000, None), (1001, ""), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, target boolean")
    buckets = [[b for _, found, _ in resampling.features(pa.array([text or ""])) for b in found.tolist()] for _, text in rows]
    target = {doc for doc, told in labels if told}
    everything, wanted = Counter(), Counter()
    for (doc, _), found in zip(rows, buckets):
        everything.update(found)
        wanted.update(found if doc in target else ())
    share = sum(wanted.values()) / sum(everything.values())
    ratio = {}
    for bucket, n in everything.items():
        expected = n * share
        if abs(wanted[bucket] - expected) / math.sqrt(expected + 1) > resampling.DEVIATIONS:
            ratio[bucket] = math.log((wanted[bucket] + resampling.PSEUDO_COUNT) / (expected + resampling.PSEUDO_COUNT))
    weights = {doc: sum(ratio.get(b, 0.0) for b in found) for (doc, _), found in zip(rows, buckets)}
    got = importance_resample(docs, known, seed=4).withColumn("noise", resampling.gumbel(4, F.col("doc_id"), F.col("text_key"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["log_weight"] == pytest.approx(weights[r["doc_id"]], abs=1e-3)
    order = sorted((r["log_weight"] + r["noise"] for r in got), reverse=True)
    k = math.floor(len(target) / len(labels) * len(rows) + 0.5)
    assert {r["doc_id"] for r in got if r["kept"]} == {r["doc_id"] for r in got if r["log_weight"] + r["noise"] >= order[k - 1]}


@pytest.mark.parametrize("k", [1, 17, 4999, 5000])
def test_kth_largest(spark, monkeypatch, k):
    monkeypatch.setattr(resampling, "LAST_ROWS", 20)
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), -1e12 * rng.random(), 5.0]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_hard_rows(spark):
    known = spark.createDataFrame([(5, True), (5, False), (6, True), (7, None), (None, True), (99, True)], "doc_id long, target boolean")
    got = importance_resample(hard(spark), known).collect()
    assert len(got) == 13 and {r["log_weight"] for r in got if r["doc_id"] in (1, 2, 3)} == {0.0}
    # Labelled: 5 (no target), 6 and 99; two of three are target.
    assert sum(r["kept"] for r in got) in (9, 10)
    assert all(r["kept"] for r in importance_resample(hard(spark), known.limit(0)).collect())
    assert importance_resample(empty(spark), known).collect() == []
    none = importance_resample(hard(spark), known, keep=0.0)
    assert none.where("kept").isEmpty()
