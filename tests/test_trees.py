import math
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.operators import ensembles, trees
from flowlens.operators.ensembles import Bags, bag_class_counts, bag_key, bag_weights, fit_boosted, fit_forest, quantile_edges
from flowlens.operators.shared import spread
from flowlens.operators.trees import LEAF, Growth, grow, merged_rows, nodes_of
from flowlens.plans import recipes


def sample(rng, n=400, classes=3):
    bins = np.stack([rng.integers(0, 9, n), rng.integers(0, 40, n), rng.integers(0, 5, n)], axis=1).astype(np.int16)
    label = (bins[:, 0] > 4).astype(int) + ((bins[:, 2] == 3) & (bins[:, 1] > 17))
    return bins, np.where(rng.random(n) < 0.1, rng.integers(0, classes, n), label)


def class_sums(label, classes=3):
    sums = np.zeros((len(label), classes + 1))
    sums[np.arange(len(label)), label] = 1
    sums[:, -1] = 1
    return sums


def gini_gain(label, right):
    def score(part):
        n = Counter(part.tolist())
        return sum(v * v for v in n.values()) / len(part) if len(part) else 0

    return score(label[right]) + score(label[~right]) - score(label)


@pytest.mark.parametrize("seed", range(5))
def test_root_split_is_the_best_of_all(seed):
    bins, label = sample(np.random.default_rng(seed))
    nodes = grow(Growth((0, 0, 5), 1, 1), 0, 1, bins, class_sums(label))
    (_, column, at, _), *leaves = nodes
    found = bins[:, column] != at if column == 2 else bins[:, column] >= at
    every = [bins[:, c] >= v for c in (0, 1) for v in range(1, 40)] + [bins[:, 2] != v for v in range(5)]
    best = max(gini_gain(label, r) for r in every if 0 < r.sum() < len(r))
    assert gini_gain(label, found) == pytest.approx(best)
    for (node, c, _, value), side in zip(leaves, (~found, found)):
        assert c == LEAF and value == pytest.approx(np.bincount(label[side], minlength=3) / side.sum())


def test_depth_leaf_size_and_drawn_features():
    bins, label = sample(np.random.default_rng(1), 2000)
    growth = Growth((0, 0, 5), 6, 3, least_rows=20, per_node=1)
    rows = grow(growth, 2, 1, bins, class_sums(label))
    nodes = nodes_of([(2, *r) for r in rows])[2]
    ends = nodes.positions(growth, bins)
    assert min(Counter(ends.tolist()).values()) >= 20 and int(nodes.ids.max()).bit_length() - 1 <= 6
    assert (nodes.column[ends] == LEAF).all() and len({r[1] for r in rows}) > 2
    for tree in range(5):
        some = Growth((0, 0, 5), 6, 3, per_tree=0.4)
        allowed = some.seen(tree)
        assert allowed.sum() == 2
        for _, c, at, _ in grow(some, tree, 1, bins, class_sums(label)):
            assert c == LEAF or allowed[some.offsets[c] + (at if some.values[c] else 0)]


def test_merging_equal_rows_changes_nothing():
    bins, label = sample(np.random.default_rng(4), 3000)
    growth = Growth((0, 0, 5), 8, 1)
    assert len(merged_rows(bins, class_sums(label))[0]) < 2000
    whole = {r[:3] for r in grow(growth, 0, 1, bins, class_sums(label))}
    assert whole == {r[:3] for r in grow(growth, 0, 1, *merged_rows(bins, class_sums(label)))}


@pytest.fixture(scope="module")
def binned(spark):
    bins, label = sample(np.random.default_rng(7), 1500)
    rows = [(i, int(y), b.tolist()) for i, (y, b) in enumerate(zip(label, bins))]
    df = spark.createDataFrame(rows, "id long, label int, bins array<smallint>")
    return df.select(bag_key(42, "id").alias("key"), "label", "bins")


def shape(found):
    return sorted(r[:4] for r in found)


@pytest.mark.parametrize("parts", [1, 5, 17])
def test_forest_does_not_depend_on_partitions_or_on_where_nodes_grow(binned, parts):
    growth = Growth((0, 0, 5), 7, 42, per_node=2, least_rows=2)
    want = fit_forest(binned, growth, 3, 4)
    for local_rows in (None, 150):
        got = fit_forest(binned.repartition(parts), growth, 3, 4, local_rows=local_rows)
        assert shape(got) == shape(want)
        values = {r[:2]: r[4] for r in want}
        assert all(values[r[:2]] == pytest.approx(r[4], abs=1e-5) for r in got if r[2] == LEAF)


def test_boosting_levels_and_subtrees_agree(binned):
    growth = Growth((0, 0, 5), 4, 42, per_tree=0.8)
    want = fit_boosted(binned, growth, 3, 12, share=0.8)
    got = fit_boosted(binned.repartition(6), growth, 3, 12, share=0.8, local_rows=200)
    assert shape(got) == shape(want) and len({r[0] for r in want}) == 36


def test_boosting_follows_the_derivatives(binned):
    """One round of stumps without splits: each class moves by -step * G / (H + 1)."""
    label = np.array([r["label"] for r in binned.select("label").collect()])
    found = fit_boosted(binned, Growth((0, 0, 5), 0, 42), 3, 1)
    for tree, node, column, _, value in found:
        slope = (1 / 3 - (label == tree)).sum()
        assert (node, column) == (1, LEAF)
        assert value[0] == pytest.approx(-0.1 * slope / (len(label) * 2 * 2 / 9 + 1), rel=1e-5)


def loss(found, growth, bins, label, rounds):
    margins = np.zeros((len(bins), 3))
    for tree, nodes in nodes_of([r for r in found if r[0] < 3 * rounds]).items():
        margins[:, tree % 3] += nodes.value[nodes.positions(growth, bins), 0]
    return -np.log(ensembles._softmax(margins)[np.arange(len(bins)), label]).mean()


def test_boosting_lowers_the_loss(binned):
    rows = binned.collect()
    bins, label = np.array([r["bins"] for r in rows], np.int16), np.array([r["label"] for r in rows])
    growth = Growth((0, 0, 5), 3, 42, boosting=True)
    found = fit_boosted(binned, growth, 3, 25)
    losses = [loss(found, growth, bins, label, n) for n in (0, 1, 5, 15, 25)]
    assert losses[0] == pytest.approx(math.log(3)) and all(a > b for a, b in zip(losses, losses[1:]))


def test_bags_are_poisson_and_alike_for_any_partitioning(spark):
    rows = spark.range(3000).select(bag_key("s", "id").alias("key"), (F.col("id") % 3 % 2).cast("int").alias("label"))
    got = {(r["bag"], r["label"]): r for r in bag_weights(bag_class_counts(rows.repartition(7), 5, 2)).collect()}
    again = bag_weights(bag_class_counts(rows.coalesce(1), 5, 2)).collect()
    assert {(r["bag"], r["label"]): r for r in again} == got
    marks, p = ensembles.poisson_marks(), ensembles.MODULUS
    want: Counter = Counter()
    sizes: Counter = Counter()
    for i in range(3000):
        x = int(md5(f"s:{i}".encode()).hexdigest()[:15], 16) % (p - 1) + 1
        for bag in range(5):
            x = x * ensembles.MULTIPLIER % p
            n = sum(x >= m for m in marks)
            want[bag, i % 3 % 2] += n
            sizes[n] += 1
    assert {k: r["n"] for k, r in got.items()} == dict(want)
    for n in range(5):
        assert sizes[n] / 15_000 == pytest.approx(math.exp(-1) / math.factorial(n), abs=0.015)
    for (bag, _), r in got.items():
        assert r["weight"] == pytest.approx((want[bag, 0] + want[bag, 1]) / (2 * r["n"]))


def test_class_absent_from_a_bag_weighs_nothing(spark):
    counts = spark.createDataFrame([(0, 0, 5, 4), (0, 1, 0, 0), (1, 0, 2, 2), (1, 1, 2, 1)], "bag int, label int, n long, n_rows long")
    got = {(r["bag"], r["label"]): r["weight"] for r in bag_weights(counts).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 1.0, (1, 1): 1.0}


def test_edges(spark):
    i = F.col("id").cast("double")
    df = spark.range(5000).select(i.alias("many"), (i % 3).alias("few"), F.lit(2.0).alias("one"), F.lit(None).cast("double").alias("none"))
    edges = quantile_edges(df.repartition(4), ["many", "few", "one", "none"], 100)
    assert edges["few"] == [1.0, 2.0] and edges["one"] == [] and edges["none"] == []
    assert edges["many"] == [math.ceil(k / 100 * 5000) - 1 for k in range(1, 100)]


@pytest.mark.parametrize("name", ["forest_vpn", "boosted"])
def test_a_narrow_band_is_learned(spark, name, tmp_path):
    """The class changes twice within a thirty-second part of the rows; the stored recipe scores alike."""
    i = F.col("id")
    inside = (F.col("duration") >= 2400) & (F.col("duration") < 2450)
    rows = spark.range(5000).select(
        i.alias("flow_id"),
        (i * 7919 % 5000).cast("double").alias("duration"),
        (i % 11).cast("double").alias("total_fiat"),
        F.when(i % 4 == 0, None).otherwise("b").alias("word"),
    ).withColumn("class1", F.when(inside, "VPN").otherwise("Non-VPN"))
    spec = recipes.FeatureSpec(("duration", "total_fiat"), ("word",))
    recipe = recipes.replace(recipes.RECIPES[name], target="class1", output="predicted_vpn", features=spec)
    params = {"numTrees": 15, "maxDepth": 8} if name == "forest_vpn" else {"maxIter": 15, "maxDepth": 4}
    trained = recipes.train(recipe, rows, **params)
    recall = {r["class"]: r["recall"] for r in recipes.evaluate(trained)["per_class_recall"].collect()}
    assert recall["VPN"] >= 0.9 and recall["Non-VPN"] > 0.998
    recipes.save_recipe(trained, str(tmp_path / "stored"))
    loaded, warnings = recipes.load_recipe(spark, str(tmp_path / "stored"))
    assert not warnings and isinstance(loaded.model, ensembles.TreeModel)
    prepared = recipes.prepare(rows, trained.spec, trained.facts)
    both = [m.model.transform(prepared).select("flow_id", "probability", "predicted_vpn") for m in (trained, loaded)]
    assert both[0].exceptAll(both[1]).isEmpty()


def test_too_many_values_of_a_category_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ensembles, "MOST_VALUES", 10)
    df = spark.range(20).select(F.col("id").cast("string").alias("x_w"))
    spec = recipes.FeatureSpec((), ("w",))
    with pytest.raises(ValueError, match="values at most"):
        ensembles.bin_values(ensembles.fit_bins(df, spec), spec)


def test_bag_rows_carry_their_weights():
    source = Bags(2, 2, np.array([[1.0, 3.0], [2.0, 4.0]]))
    assert source.sums(1, np.array([[1, 2], [0, 1]], np.int16)).tolist() == [[0, 8, 1], [2, 0, 1]]
    assert trees.scrambled(1, np.arange(3)).shape == (3,)


def test_columns_looked_at_first_find_the_split_that_all_columns_give(monkeypatch):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 30, (4000, 6)).astype(np.int16)
    bins[:, 5] %= 4
    label = ((bins[:, 0] > 12) ^ (bins[:, 5] == 2)).astype(int)
    growth = Growth((0, 0, 0, 0, 0, 4), 9, 5, per_node=2, least_rows=2)
    assert growth.first_columns(1, np.arange(1, 200)).mean() < 0.9
    got = [grow(growth, tree, 1, bins, class_sums(label, 2)) for tree in range(4)]
    monkeypatch.setattr(Growth, "first_columns", lambda self, tree, ids: np.ones((len(ids), len(self.values)), bool))
    assert got == [grow(growth, tree, 1, bins, class_sums(label, 2)) for tree in range(4)]


def test_a_task_sends_the_sums_of_one_tree_at_a_time_over_all_its_batches():
    rng = np.random.default_rng(2)
    bins, label = sample(rng, 3000)
    growth = Growth((0, 0, 5), 7, 42, per_node=1)
    batches = [
        pa.record_batch(
            [pa.array(rng.integers(1, 1 << 30, 100)), pa.array(label[a : a + 100].astype(np.int32)), pa.array(bins[a : a + 100].tolist(), pa.list_(pa.int16()))],
            ["key", "label", "bins"],
        )
        for a in range(0, 3000, 100)
    ]
    nodes = frozenset((t, 1) for t in range(20))
    sent = list(trees._send_cells(growth, Bags(20, 3), {}, nodes, frozenset())(iter(batches)))
    assert [set(b.column("tree").to_pylist()) for b in sent] == [{t} for t in range(20)]
    looked = sum(int(growth.first_columns(t, np.array([1])).sum()) for t in range(20))
    assert sum(b.num_rows for b in sent) == looked < 60
    again = list(trees._send_cells(growth, Bags(20, 3), {}, nodes, nodes)(iter(batches)))
    assert sum(b.num_rows for b in again) == 60


def test_rows_of_trees_are_spread_over_all_cores(spark):
    few = spark.range(1000).coalesce(1)
    assert spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_nodes_split_one_by_one_and_by_level_alike(monkeypatch):
    bins, label = sample(np.random.default_rng(5), 6000)
    growth = Growth((0, 0, 5), 9, 3, per_node=2, least_rows=3)
    sums = class_sums(label) * [2.0, 1.0, 3.0, 1.0]
    found = []
    for many in (1, 300, 10**9):
        monkeypatch.setattr(trees, "MANY_ROWS", many)
        found.append(sorted(grow(growth, 1, 1, bins, sums), key=lambda r: r[0]))
    assert [r[:3] for r in found[0]] == [r[:3] for r in found[1]] == [r[:3] for r in found[2]]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(found[0], found[2]) if a[1] == LEAF)


def test_draws_by_the_table_are_those_of_the_marks():
    source = Bags(3, 2)
    near = (source.marks[:, None] + np.arange(-2, 3)).ravel()
    near = near[near < ensembles.MODULUS]
    at = np.concatenate([near, np.random.default_rng(1).integers(1, ensembles.MODULUS, 5000)]).astype(np.int64)
    # The key whose number for the second bag is the one to be looked at.
    back = pow(int(source.factors[1]), -1, ensembles.MODULUS)
    keys = np.array([int(x) * back % ensembles.MODULUS for x in at], np.int64)
    assert source.drawn(keys, 1).tolist() == source.draws(keys)[:, 1].tolist()
    assert source.drawn(keys, 1).tolist() == np.searchsorted(source.marks, at, side="right").tolist()


def test_copies_of_a_row_are_looked_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    bins, label = sample(rng, 300)
    bins, label = np.repeat(bins, 9, axis=0), np.repeat(label, 9)
    columns = [pa.array(rng.integers(1, 1 << 30, 2700)), pa.array(label.astype(np.int32)), pa.array(bins.tolist(), pa.list_(pa.int16()))]
    batch = pa.record_batch(columns, ["key", "label", "bins"])
    source = Bags(4, 3, np.array([[1.5, 0.7, 2.2]] * 4))
    growth = Growth((0, 0, 5), 9, 3, per_node=2, least_rows=2)

    def grown(tree, rows, said):
        found = sorted(grow(growth, tree, 1, bins[rows], source.sums(tree, said)), key=lambda r: r[0])
        return [r[:3] for r in found], [r[3] for r in found if r[1] == LEAF]

    for block in (2000, 4):
        monkeypatch.setattr(ensembles, "ALIKE_ROWS", block)
        for tree, rows, said in source.rows(batch):
            draws = source.drawn(columns[0].to_numpy(), tree)
            apart = np.flatnonzero(draws)
            plain = np.stack([label[apart], draws[apart], np.ones(len(apart))], axis=1).astype(np.int16)
            assert len(rows) <= (300 if block > 9 else 900) < len(apart)
            assert said[:, 1].sum() == draws.sum() and said[:, 2].sum() == len(apart)
            (shape_of, values), (want, wanted) = grown(tree, rows, said), grown(tree, apart, plain)
            assert shape_of == want and all(a == pytest.approx(b) for a, b in zip(values, wanted))


def test_copies_stay_together_unless_very_many(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(recipes, "fit_forest", lambda table, *a: kept.append(table) or [(0, 1, LEAF, 0, [1.0, 0.0])])
    rows = spark.range(400).selectExpr(
        "id as flow_id", "'tcp' as proto", "'-' as service", "'FIN' as state", "cast(id as double) as sbytes",
        "1.0D as dbytes", "case when id < 2 then 'Worms' else 'Normal' end as attack_cat",
    )
    recipes.train(recipes.RECIPES["forest_oversampled"], rows)
    parts = kept[0].select("bins", F.spark_partition_id().alias("p"), F.input_file_name().alias("f"))
    of_one = parts.groupBy("bins").agg(F.count("*").alias("n"), F.countDistinct("f").alias("files")).collect()
    many = [r for r in of_one if r["n"] > 100]
    assert sum(r["n"] for r in of_one) == 2 * 318 and many
    assert all(1 < r["files"] <= -(-r["n"] // recipes._COPIES_TOGETHER) for r in many)


def test_packed_sums_of_a_node_equal_plain_ones(monkeypatch):
    bins, label = sample(np.random.default_rng(6), 9000)
    sums = class_sums(label) * [2.5, 1.0, 0.3, 1.0]
    growth = Growth((0, 0, 5), 9, 3, per_node=2, least_rows=3)
    packed = sorted(grow(growth, 1, 1, bins, sums), key=lambda r: r[0])
    assert trees._Rows(growth, bins, sums).label is not None
    monkeypatch.setattr(trees._Rows, "_pack", lambda self: None)
    plain = sorted(grow(growth, 1, 1, bins, sums), key=lambda r: r[0])
    assert [r[:3] for r in packed] == [r[:3] for r in plain]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(packed, plain) if a[1] == LEAF)


def test_rows_are_sent_as_few_bytes_and_in_jobs_of_bounded_size(monkeypatch):
    rng = np.random.default_rng(8)
    bins, label = sample(rng, 3000)
    batch = pa.record_batch(
        [pa.array(rng.integers(1, 1 << 30, 3000)), pa.array(label.astype(np.int32)), pa.array(bins.tolist(), pa.list_(pa.int16()))],
        ["key", "label", "bins"],
    )
    source, growth = Bags(3, 3, np.array([[1.5, 0.7, 2.2]] * 3)), Growth((0, 0, 5), 9, 3, per_node=2, least_rows=2)
    layout = trees.Layout(source.bits(bins.max(axis=0)))
    sent = pa.Table.from_batches(trees._send_rows(growth, source, {}, frozenset({(0, 1), (2, 1)}), layout)(iter([batch])))
    assert sent.column("tree").to_pylist() == [0, 2]
    keys = batch.column("key").to_numpy()
    for i, tree in enumerate((0, 2)):
        drawn = np.flatnonzero(source.drawn(keys, tree))
        assert len(sent["bins"][i].as_py()) + len(sent["sums"][i].as_py()) <= 9 * len(drawn)
        got = trees._finish(growth, source, layout)(sent.slice(i, 1)).to_pylist()
        said = np.stack([label[drawn], source.drawn(keys, tree)[drawn], np.ones(len(drawn))], axis=1).astype(np.int16)
        want = grow(growth, tree, 1, bins[drawn], source.sums(tree, said))
        assert sorted((r["node"], r["column"], r["bin"]) for r in got) == sorted(r[:3] for r in want)
    monkeypatch.setattr(trees, "JOB_BYTES", 1000)
    small = {(t, n): 50 for t in range(4) for n in (2, 3)}
    assert [sorted(x) for x in trees._jobs(small, 9)] == [[(t, 2), (t, 3)] for t in range(4)]
    monkeypatch.setattr(trees, "JOB_BYTES", 2000)
    assert [len(x) for x in trees._jobs(small, 9)] == [4, 4]


def test_words_hold_what_was_put_in():
    rng = np.random.default_rng(9)
    bits = [3, 11, 0, 16, 30, 7, 1]
    columns = [rng.integers(0, 1 << n, 500) for n in bits]
    layout = trees.Layout(bits)
    words = layout.pack(columns)
    assert words.shape == (500, 2)
    assert all((layout.column(words, i) == c).all() for i, c in enumerate(columns))


def test_subtrees_leave_no_shuffle_files(binned, tmp_path, monkeypatch):
    """Rows sent in several jobs give the trees of one job, and the shuffle setting is as before."""
    growth = Growth((0, 0, 5), 7, 42, per_node=2, least_rows=2)
    spark = binned.sparkSession
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    want = fit_forest(binned, growth, 3, 4)
    dropped = []
    plain = trees.shuffles_dropped
    monkeypatch.setattr(trees, "shuffles_dropped", lambda s: dropped.append(1) or plain(s))
    monkeypatch.setattr(trees, "JOB_BYTES", 9 * 1500)
    assert shape(fit_forest(binned, growth, 3, 4)) == shape(want) and len(dropped) > 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before


def test_derivatives_of_a_large_node_are_summed_without_lines_of_all_rows(monkeypatch):
    rng = np.random.default_rng(10)
    bins, _ = sample(rng, 5000)
    sums = np.column_stack([rng.normal(size=5000), rng.random(5000), np.ones(5000)])
    here = trees._Rows(Growth((0, 0, 5), 8, 3, boosting=True), bins, sums)
    rows = np.flatnonzero(rng.random(5000) < 0.7)
    want = [trees.cells_of(np.zeros(len(rows), np.int64), bins[rows, c].astype(np.int64), sums[rows]) for c in range(3)]
    monkeypatch.setattr(trees, "cells_of", None)
    for c in range(3):
        got = here.cells_of_one(c, rows, here.told(rows))
        assert all((a == b).all() for a, b in zip(got, want[c]))
