import math
from itertools import combinations

import numpy as np
import pytest
from common import SMALL, rows_of

from flowlens.llm import multiprobe
from flowlens.llm.multiprobe import Tables, nearest_neighbours, probing_sequence
from flowlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, modulus=20):
    """(query, rank) -> (id, score), nearest first."""
    usable = {}
    for vec_id, vector, *_ in rows:
        if vec_id is None or vector is None or not any(vector) or not all(x is not None and math.isfinite(x) for x in vector):
            continue
        usable[vec_id] = np.array(vector, np.float64)
    out = {}
    for q, v in usable.items():
        if q % modulus:
            continue
        scores = []
        for i, w in usable.items():
            n = min(len(v), len(w))
            scores.append((-float((v[:n] * w[:n]).sum()), i))
        ranked = sorted(s for s in scores if s[1] != q)[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(ranked)}
    return out


def recall_of(got, want, k):
    """Share of the true neighbours found; one as near as the last true one counts as well."""
    hits = sum(1 for key, (i, score) in got.items() if score >= want[(key[0], max(r for q, r in want if q == key[0]))][1] - 1e-9)
    return hits / len(want)


def collected(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def vectors(rng, n, dimensions, clusters):
    centres = rng.standard_normal((clusters, dimensions))
    return centres[rng.integers(clusters, size=n)] + rng.standard_normal((n, dimensions)) * rng.uniform(0.2, 1, (n, 1))


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got, want = collected(QUERIES["op12_multiprobe_neighbours"](spark, SMALL)), brute(rows)
    assert set(got) == set(want)
    assert recall_of(got, want, 20) >= 0.95
    for (q, _), (i, score) in got.items():
        a, b = np.array(rows[q][1], np.float64), np.array(rows[i][1], np.float64)
        assert score == pytest.approx(float((a * b).sum()), abs=1e-12)


def test_recall_with_many_buckets(spark):
    """Norms differ, so inner product and distance rank differently; buckets are small, visits few."""
    rng = np.random.default_rng(5)
    points = vectors(rng, 3000, 24, 40) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute(rows, 10)
    got = collected(nearest_neighbours(df, 10, bucket_points=60, sample_queries=50))
    assert set(got) == set(want)
    assert recall_of(got, want, 10) >= 0.9
    again = collected(nearest_neighbours(df.repartition(3), 10, bucket_points=60, sample_queries=50))
    assert again == got


def test_fewer_candidates_than_rows(spark):
    """With small buckets in separate clusters, queries meet a part of the points only."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16)) * 4
    points = centres[rng.integers(30, size=4000)] + rng.standard_normal((4000, 16)) * 0.3
    hashes = Tables(16, 3, 6, 1.5, float(np.linalg.norm(points, axis=1).max()), 7)
    held, visits = hashes.of_points(points), hashes.of_queries(points[:50], probing_sequence(6)[:12])
    met = np.zeros((50, 4000), bool)
    for t in range(3):
        met |= (visits[:, t, :, None] == held[:, t]).any(axis=1)
    assert met.mean() < 0.6


@pytest.mark.parametrize("functions", [1, 2, 3, 4])
def test_sequence_is_whole_and_in_order(functions):
    m = functions
    cost = {}
    for j in range(1, 2 * m + 1):
        k = 2 * m + 1 - j
        cost[j] = j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    got = probing_sequence(m)
    allowed = [
        c for n in range(m + 1) for c in combinations(range(1, 2 * m + 1), n) if not any(2 * m + 1 - j in c for j in c)
    ]
    assert sorted(got) == sorted(allowed) and len(got) == 3**m
    costs = [sum(cost[j] for j in c) for c in got]
    assert all(a <= b + 1e-12 for a, b in zip(costs, costs[1:]))


def test_visits_are_the_neighbouring_slots():
    rng = np.random.default_rng(1)
    hashes = Tables(8, 2, 3, 1.5, 1.0, 3)
    queries = rng.standard_normal((20, 8))
    visits = hashes.of_queries(queries, probing_sequence(3))
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    assert (visits[:, :, 0] == hashes.of_points(unit)).all()
    slots = np.floor(hashes._slots(unit, np.zeros(20)))
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    for i in range(20):
        for t in range(2):
            assert set(visits[i, t]) == {int(hashes._bucket(slots[i, t] + np.array(d))) for d in around}


def test_copies_and_blocks(spark, monkeypatch):
    """A third of the rows are one vector, all of whose ids ask; buckets are dealt into blocks."""
    rng = np.random.default_rng(9)
    points = vectors(rng, 600, 8, 5)
    points[rng.permutation(600)[:200]] = points[0]
    rows = [(i * 10, v.astype(np.float32).tolist(), 0) for i, v in enumerate(points)]
    monkeypatch.setattr(multiprobe, "BLOCK_POINTS", 50)
    got = collected(nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5), 5))
    want = brute(rows, 5)
    assert set(got) == set(want)
    assert recall_of(got, want, 5) >= 0.97
    copies = [i for i, v, _ in rows if v == rows[0][1]]
    for q in copies:
        if q % 20 == 0:
            nearest = [x for x in copies if x != q][:5]
            assert [got[(q, r)][0] for r in range(1, 6)] == nearest or want[(q, 1)][1] > got[(q, 5)][1]


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "a"), (1, None, "a"), (2, [0.0, 0.0], "a"), (3, [None, 1.0], "a"),
        (4, [nan, 1.0], "a"), (40, [inf, 1.0], "a"), (5, [0.5, 0.5, 0.5], "a"), (6, [-1.0], "a"), (None, [1.0, 1.0], "a"),
        (7, [0.0, -0.0, 2.0], "a"), (0, [1.0, 0.0], "b"), (8, [], "b"), (9, [2.0, 0.0, 0.0], None), (60, [0.0, -1.0], "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vector string").repartition(3)
    got = collected(nearest_neighbours(df))
    want = brute(rows)
    assert got == want
    assert [got[(0, r)] for r in (1, 2, 3)] == [(9, 2.0), (20, 1.0), (5, 0.5)]
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = spark.createDataFrame([(20, [1.0], 0)], SCHEMA)
    assert nearest_neighbours(alone).collect() == []
    assert rows_of(nearest_neighbours(spark.createDataFrame([(7, [1.0], 0)], SCHEMA)), "query_id") == []


def test_ties_go_to_the_smaller_id(spark):
    """Hundreds of different vectors have one inner product with the query."""
    rows = [(i, [1.0, float(i % 7), float(i)], 0) for i in range(1, 400)] + [(0, [1.0, 0.0, 0.0], 0)]
    got = collected(nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), 20, 1000))
    assert [got[(0, r)] for r in range(1, 21)] == [(i, 1.0) for i in range(1, 21)]
