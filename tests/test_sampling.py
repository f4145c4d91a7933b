import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import neighbours, sampling, shared
from flowlens.operators.smote import smote, smote_settings


def skewed(spark, sizes, parts=4):
    rows = [(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, y string").repartition(parts)


SIZES = {"Normal": 900, "DoS": 40, "Worms": 7, "One": 1}


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_split_is_exact_and_partition_free(spark, parts):
    df = skewed(spark, SIZES, parts)
    rows = sampling.tag_split(df, "y", "id").collect()
    assert len(rows) == sum(SIZES.values())
    test = Counter(r["y"] for r in rows if r["split"] == "test")
    assert test == {c: math.ceil(n / 5) for c, n in SIZES.items()}
    # The same rows for every partitioning: the digest of the chosen ids is fixed.
    chosen = sorted(r["id"] for r in rows if r["split"] == "test")
    again = sampling.tag_split(skewed(spark, SIZES, 3), "y", "id").where("split = 'test'").collect()
    assert chosen == sorted(r["id"] for r in again)


def test_split_sides_cover_all(spark):
    df = skewed(spark, SIZES)
    train, test = sampling.stratified_split(df, "y", "id")
    assert train.intersect(test).isEmpty() and train.count() + test.count() == df.count()


def test_split_without_lookups(spark, monkeypatch):
    """More classes than a lookup may hold: same rows through plain joins."""
    df = skewed(spark, SIZES)
    expected = sorted(tuple(r) for r in sampling.tag_split(df, "y", "id").collect())
    monkeypatch.setattr(shared, "collect_lookup", lambda *a, **k: None)
    assert sorted(tuple(r) for r in sampling.tag_split(df, "y", "id").collect()) == expected


def test_split_with_longer_prefixes(spark, monkeypatch):
    """A prefix with too many rows to rank is counted again by more digits, to the same result."""
    df = skewed(spark, SIZES)
    expected = sorted(tuple(r) for r in sampling.tag_split(df, "y", "id").collect())
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    monkeypatch.setattr(sampling, "_RANKED_ROWS", 2)
    assert sorted(tuple(r) for r in sampling.tag_split(df, "y", "id").collect()) == expected


def test_split_of_null_class(spark):
    df = spark.createDataFrame([(str(i), None if i < 10 else "a") for i in range(20)], "id string, y string")
    sides = sampling.tag_split(df, "y", "id").groupBy("y", "split").count().collect()
    assert sorted(r["count"] for r in sides) == [2, 2, 8, 8]


@pytest.mark.parametrize("cap", [0, 1, 120, 900, 5000])
def test_undersample_is_exact(spark, cap):
    df = skewed(spark, SIZES)
    got = Counter(r["y"] for r in sampling.undersample(df, "y", "id", cap).collect())
    assert got == Counter({**SIZES, "Normal": min(900, cap)})


def test_cap_from_the_next_class(spark):
    assert sampling.three_times_largest_other(skewed(spark, SIZES), "y") == 120
    assert sampling.three_times_largest_other(skewed(spark, {"Normal": 3}), "y") is None


def test_oversample_is_exact_and_keeps_originals(spark):
    df = skewed(spark, SIZES)
    got = sampling.oversample(df, "y", "id").collect()
    assert Counter(r["y"] for r in got) == dict.fromkeys(SIZES, 900)
    assert len({r["id"] for r in got}) == sum(SIZES.values())
    assert Counter(r["copy"] for r in got)[0] == sum(SIZES.values())
    per_row = Counter(r["id"] for r in got if r["y"] == "Worms")
    assert max(per_row.values()) - min(per_row.values()) == 1


def test_oversample_in_blocks(spark, monkeypatch):
    """Very many copies of one row are emitted block by block, with the same result."""
    df = skewed(spark, {"Normal": 500, "One": 1, "Few": 3})
    expected = sorted(tuple(r) for r in sampling.oversample(df, "y", "id").collect())
    monkeypatch.setattr(shared, "COPIES_PER_BLOCK", 7)
    assert sorted(tuple(r) for r in sampling.oversample(df, "y", "id").collect()) == expected


def test_oversample_target_spares_exempt_and_larger(spark):
    df = skewed(spark, SIZES)
    got = Counter(r["y"] for r in sampling.oversample(df, "y", "id", target=30, exempt=["One"]).collect())
    assert got == {"Normal": 900, "DoS": 40, "Worms": 30, "One": 1}


def test_class_weights(spark):
    got = {r["class"]: r["weight"] for r in sampling.class_weights(skewed(spark, {"a": 3, "b": 1}), "y").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_smote_settings():
    assert smote_settings({"a": 10, "b": 3000, "c": 9000}) == (3000, 5, {"a": 10})
    assert smote_settings({"a": 3, "b": 2500}, floor=10) == (10, 2, {"a": 3})
    with pytest.raises(ValueError, match="single row"):
        smote_settings({"a": 1, "b": 50})


def cloud(spark, n=300, seed=1, parts=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        cls = "rare" if i % 3 else "other"
        kind = rng.integers(3)
        # A hot point, a line of ties on the first axis, and a heavy-tailed cloud.
        x, y = [(5.0, 5.0), (0.0, float(rng.integers(50))), tuple(np.round(rng.lognormal(3, 2, 2), 1))][kind]
        rows.append((i, cls, float(x), float(y), None if i % 11 == 0 else "tcp" if i % 2 else "udp"))
    rows += [(10_000 + i, "big", float(i), 0.0, "tcp") for i in range(400)]
    return spark.createDataFrame(rows, "id int, y string, a double, b double, c string").repartition(parts)


def run_smote(df, **kwargs):
    return smote(df, "y", "id", ["a", "b"], ["c"], floor=400, **kwargs)


def onehot(c):
    return {"tcp": (1.0, 0.0), "udp": (0.0, 1.0), None: (0.0, 0.0)}[c]


@pytest.mark.parametrize("bits", [11, 4])
def test_smote_lies_between_true_neighbours(spark, monkeypatch, bits):
    monkeypatch.setattr(neighbours, "_TILE_BITS", bits)
    df = cloud(spark)
    k = 5
    got = run_smote(df).collect()
    assert Counter(r["y"] for r in got) == {"rare": 400, "other": 400, "big": 400}
    rows = df.collect()
    for cls in ("rare", "other"):
        points = np.array([(r["a"], r["b"], *onehot(r["c"])) for r in rows if r["y"] == cls])
        made = [r for r in got if r["y"] == cls and r["synthetic"]]
        assert len(made) == 400 - len(points)
        for r in made:
            gap = r["gap"]
            assert 0 <= gap < 1
            base_cat, near_cat = onehot(r["c"]), onehot(r["c_nb"])
            ok = False
            # Some base of that category and one of its k nearest rows explain the new point.
            for i, p in enumerate(points):
                if tuple(p[2:]) != base_cat:
                    continue
                dist = ((points - p) ** 2).sum(axis=1)
                dist[i] = np.inf
                kth = np.sort(dist)[k - 1]
                near = points[(dist <= kth) & (points[:, 2:] == near_cat).all(axis=1)]
                if len(near) and (np.abs(p[:2] + gap * (near[:, :2] - p[:2]) - (r["a"], r["b"])) < 1e-6).all(axis=1).any():
                    ok = True
                    break
            assert ok, r


def test_smote_does_not_depend_on_tiles_or_partitions(spark, monkeypatch):
    columns = ["y", "a", "b", "c", "c_nb", "gap", "synthetic"]
    expected = sorted(map(repr, run_smote(cloud(spark)).select(columns).collect()))
    monkeypatch.setattr(neighbours, "_TILE_BITS", 3)
    assert sorted(map(repr, run_smote(cloud(spark, parts=17)).select(columns).collect())) == expected
    # Groups of several tiles, and tiles with more visitors than a block takes.
    monkeypatch.setattr(neighbours, "_GROUPS", 4)
    monkeypatch.setattr(neighbours, "_VISITORS", 2)
    assert sorted(map(repr, run_smote(cloud(spark, parts=17)).select(columns).collect())) == expected


def test_smote_does_not_depend_on_regions(spark, monkeypatch):
    """Classes of more points than a region are cut by a tree over sampled points, to the same rows."""
    columns = ["y", "a", "b", "c", "c_nb", "gap", "synthetic"]
    expected = sorted(map(repr, run_smote(cloud(spark)).select(columns).collect()))
    monkeypatch.setattr(neighbours, "_TILE_BITS", 3)
    for region, regions in ((64, 1 << 14), (20, 3), (1, 8)):
        monkeypatch.setattr(neighbours, "_REGION_POINTS", region)
        monkeypatch.setattr(neighbours, "_REGIONS", regions)
        assert sorted(map(repr, run_smote(cloud(spark)).select(columns).collect())) == expected


def clumps(n, columns, seed=3):
    """Points around forty centres, the columns of very different widths, two of them with few values."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, columns))[rng.integers(40, size=n)] + rng.normal(scale=0.2, size=(n, columns))
    x *= 10.0 ** rng.integers(-1, 4, columns)
    x[:, 0], x[:, 1] = np.round(x[:, 0]), 7.0
    return x


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_halves_are_a_partition(size):
    x = clumps(1000, 5)
    parts = neighbours._halves(x, size)
    assert max(map(len, parts)) <= size
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000))


def test_trees_cut_regions_of_like_size():
    x = clumps(20_000, 8)
    tree = neighbours._grow(x[::20], 50)
    region = neighbours._descend(tree, x)
    sizes = np.bincount(region)
    assert 30 <= len(sizes) <= 110 and sizes.min() > 0 and sizes.max() <= 4 * 20_000 / 50
    same = np.full((100, 3), 2.0)
    assert set(neighbours._descend(neighbours._grow(same, 50), same)) == {0}
    tied = np.repeat([[1.0, 0.0], [1.0, 1.0], [2.0, 0.0]], [500, 1, 1], axis=0)
    regions = neighbours._descend(neighbours._grow(tied, 50), tied)
    assert len(set(regions[:500])) == 1 and len(set(regions)) == 3


def tiled_boxes(x, size):
    """Boxes over halved points in tree order, as the driver builds them from groups of one tile."""
    import pandas as pd

    names = [f"x{i}" for i in range(x.shape[1])]
    parts = neighbours._halves(x, size)
    rows = [{"y": "a", "slice": 0, "part": i, "tiles": 1} for i in range(len(parts))]
    for row, part in zip(rows, parts):
        row |= {f"lo_{c}": v for c, v in zip(names, x[part].min(axis=0))}
        row |= {f"hi_{c}": v for c, v in zip(names, x[part].max(axis=0))}
    return parts, neighbours._box_arrays(pd.DataFrame(rows), "y", names)["a"]


def test_reached_boxes_equal_brute_force():
    x = clumps(600, 4)
    _, boxes = tiled_boxes(x, 16)
    lo, hi = boxes["levels"][0]
    limit = np.random.default_rng(5).exponential(np.var(x), len(x))
    limit[::50], limit[1::50] = np.inf, 0.0
    gap = np.maximum(np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]), 0)
    expected = set(zip(*np.nonzero((gap**2).sum(axis=2) <= limit[:, None])))
    got = list(zip(*neighbours._reached(x, limit, boxes["levels"])))
    assert len(got) == len(set(got)) and set(got) == expected


def test_visits_per_point_stay_few_in_eight_columns(spark, tables):
    """Tiles that a point has to ask beside its own, on the eight measures: few, and no more with twice the points."""
    from flowlens.functions import domain

    x = tables.vpn.select(*domain.VPN_COLUMNS).distinct().toPandas().to_numpy(float)
    asked = []
    for points in (x[::2], x):
        parts, boxes = tiled_boxes(points, 16)
        reach = np.empty(len(points))
        for part in parts:
            within = ((points[part][:, None] - points[part][None]) ** 2).sum(axis=2)
            reach[part] = np.sort(within, axis=1)[:, min(5, len(part) - 1)]
        query, _ = neighbours._reached(points, reach, boxes["levels"])
        asked.append(len(query) / len(points) - 1)
    assert asked[1] < 15 and asked[1] < 1.5 * asked[0], asked


def test_smote_takes_any_number_of_classes(spark, monkeypatch):
    from flowlens.operators import shared

    monkeypatch.setattr(shared, "LOOKUP_ROWS", 3)
    monkeypatch.setattr(shared.collect_lookup, "__defaults__", (3,))
    df = spark.createDataFrame([(i, f"y{i % 8}", float(i), 0.0, "tcp") for i in range(48)], "id int, y string, a double, b double, c string")
    got = smote(df, "y", "id", ["a", "b"], ["c"], floor=10)
    assert {r["count"] for r in got.groupBy("y").count().collect()} == {10}


def test_smote_leaves_large_classes_alone(spark):
    df = cloud(spark)
    got = smote(df, "y", "id", ["a", "b"], ["c"], floor=50)
    assert got.count() == df.count() and got.where("synthetic").isEmpty()


def test_with_class_weights_keeps_rows(spark):
    df = skewed(spark, SIZES)
    got = sampling.with_class_weights(df, "y")
    assert got.count() == df.count()
    total = got.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(sum(SIZES.values()))


def test_smote_digests_its_rows_once(spark, monkeypatch):
    """The passes over the rows of small classes read stored digests."""
    from flowlens.operators import smote as module

    written = []
    monkeypatch.setattr(module, "written_table", lambda df, name: written.append(df) or shared.written_table(df, name))
    monkeypatch.setattr(sampling, "hash_key", None)
    got = run_smote(cloud(spark))
    assert len(written) == 1 and "__digest" in written[0].columns and "__digest" not in got.columns
    assert got.count() > 0


def test_numbers_that_are_equal_share_the_first_key(spark):
    row = spark.sql("select xxhash64('a', 0.0d), xxhash64('a', -0.0d), xxhash64('a', double('nan'))").first()
    assert row[0] == row[1] != row[2]
