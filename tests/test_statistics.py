import math
import random
from statistics import median

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.operators import evaluation, stats
from flowlens.operators.drift import drift
from flowlens.operators.soc import soc_metrics, top_attack

JS_MAX = math.sqrt(math.log(2))


def medians(spark, values, parts=3):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
    return stats.fit_medians(df, ["x"])["x"]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 101, 1000])
def test_median_is_exact(spark, size):
    rng = random.Random(size)
    for draw in (lambda: rng.uniform(-1e6, 1e6), lambda: rng.lognormvariate(0, 8), lambda: float(rng.randrange(3))):
        values = [draw() for _ in range(size)]
        assert medians(spark, values) == median(values)


def test_median_of_close_values(spark):
    base = 1e9
    values = [base + i * 1e-6 for i in range(50)]
    assert medians(spark, values) == median(values)


def test_median_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (9.0,)], "x double")
    assert stats.fit_medians(df, ["x"]) == {"x": 2.0}
    assert stats.fit_medians(df.where("x is null"), ["x"]) == {"x": None}


def test_median_with_infinities(spark):
    inf = float("inf")
    assert medians(spark, [inf, inf, 1.0]) == inf
    assert medians(spark, [-inf, 1.0, inf]) == 1.0


def test_median_when_lookup_is_too_large(spark, monkeypatch):
    """Many keys: the passes then stay joins instead of collected lookups."""
    monkeypatch.setattr(stats, "collect_lookup", lambda df: None)
    rows = [(k, float((k * 37 + i * i) % 101)) for k in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r["k"]: r["median"] for r in stats.column_medians(df, ["x"], ["k"]).collect()}
    assert got == {k: median([x for kk, x in rows if kk == k]) for k in range(5)}


def test_mode_takes_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert stats.fit_modes(df, ["x"]) == {"x": "a"}


def test_report_by_hand(spark):
    pairs = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "d")]
    df = spark.createDataFrame(pairs, "y string, p string")
    rows = {r["class"]: r for r in evaluation.classification_report(df, "y", "p").collect()}
    assert rows["a"]["precision"] == pytest.approx(2 / 3) and rows["a"]["recall"] == 0.5
    assert rows["c"]["precision"] == 0.0 and rows["c"]["f1_score"] == 0.0
    assert rows["d"]["support"] == 0 and rows["d"]["recall"] == 0.0
    assert rows["accuracy"]["f1_score"] == 0.5
    f1 = [4 / 7, 2 / 3, 0.0, 0.0]
    assert rows["macro avg"]["f1_score"] == pytest.approx(sum(f1) / 4)
    assert rows["weighted avg"]["f1_score"] == pytest.approx((4 * f1[0] + f1[1]) / 6)
    recalled = {r["class"] for r in evaluation.per_class_recall(df, "y", "p").collect()}
    assert recalled == {"a", "b", "c"}


def distribution(spark, shares):
    return spark.createDataFrame(list(shares.items()), "class string, share double")


def labels(spark, counts):
    return spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "p string")


def direct(p, q):
    total_p, total_q = sum(p.values()), sum(q.values())
    out = 0.0
    for c in set(p) | set(q):
        a, b = p.get(c, 0) / total_p, q.get(c, 0) / total_q
        out += (a * math.log(2 * a / (a + b)) if a else 0) + (b * math.log(2 * b / (a + b)) if b else 0)
    return math.sqrt(max(out / 2, 0))


weights = st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 9), min_size=1)


@settings(max_examples=8, deadline=None)
@given(p=weights, q=weights)
def test_drift_property(spark, p, q):
    got = drift(distribution(spark, {c: float(n) for c, n in p.items()}), labels(spark, q), "p").first()
    assert got["js_distance"] == pytest.approx(direct(p, q), abs=1e-7)
    assert 0 <= got["js_distance"] <= JS_MAX + 1e-9
    assert got["drift_detected"] == (got["js_distance"] > 0.2)


def test_drift_edges(spark):
    same = drift(distribution(spark, {"a": 0.25, "b": 0.75}), labels(spark, {"a": 1, "b": 3}), "p").first()
    assert same["js_distance"] == 0.0 and not same["drift_detected"]
    apart = drift(distribution(spark, {"a": 1.0}), labels(spark, {"b": 2}), "p").first()
    assert apart["js_distance"] == pytest.approx(JS_MAX) and apart["drift_status"] == "Concept Drift Detected"
    empty = drift(distribution(spark, {"a": 1.0}), labels(spark, {"a": 1}).where("false"), "p").first()
    assert empty["js_distance"] is None and empty["drift_detected"] is False


def test_drift_per_key_equals_single(spark):
    rows = [("x", "a"), ("x", "b"), ("y", "c"), ("y", "c"), (None, "a")]
    df = spark.createDataFrame(rows, "k string, p string")
    train = distribution(spark, {"a": 0.5, "b": 0.3, "d": 0.2})
    per_key = {r["k"]: r["js_distance"] for r in drift(train, df, "p", by=["k"]).collect()}
    for key in ("x", "y", None):
        alone = drift(train, df.where(F.col("k").eqNullSafe(key)), "p").first()["js_distance"]
        assert per_key[key] == pytest.approx(alone, abs=1e-12)


def scored(spark, rows):
    return spark.createDataFrame(rows, "predicted_attack string, predicted_vpn string")


def test_soc_bounds(spark):
    train = distribution(spark, {"Normal": 1.0})
    ids = scored(spark, [("DoS", None)] * 3 + [("Worms", None)] * 2).drop("predicted_vpn")
    got = soc_metrics(ids, train, input_type="ids").first()
    # All classes count as attacks, so a scored intrusion table never falls below 50 points.
    assert got["attack_percentage"] == 100.0 and got["malicious_percentage"] == 100.0
    assert got["risk_score"] == pytest.approx(round(50 + 30 * JS_MAX, 2)) and got["threat_level"] == "High"
    assert got["top_attack"] == "DoS"
    vpn = scored(spark, [(None, "VPN"), (None, "vpn"), (None, "Non-VPN")]).drop("predicted_attack")
    got = soc_metrics(vpn, None, input_type="vpn").first()
    assert got["risk_score"] == 13.33 and got["threat_level"] == "Low" and got["top_attack"] == "N/A"
    assert got["js_distance"] is None and got["drift_detected"] is False


def test_soc_benign_only_and_unsupported(spark):
    df = scored(spark, [("Normal", "Non-VPN")] * 4)
    got = soc_metrics(df, distribution(spark, {"Normal": 1.0}), input_type="mixed").first()
    assert got["top_attack"] == "Normal" and got["malicious_percentage"] == 0.0 and got["risk_score"] == 50.0
    got = soc_metrics(df, None, input_type="unsupported").first()
    assert (got["top_attack"], got["risk_score"], got["threat_level"]) == ("N/A", 0.0, "N/A")
    assert got["status_message"] == "Network Status: Not Available"
    empty = soc_metrics(df.where("false"), distribution(spark, {"Normal": 1.0}), input_type="mixed").first()
    assert empty["total_records"] == 0 and empty["risk_score"] == 0.0 and empty["top_attack"] == "N/A"


def test_top_attack_ties_by_name(spark):
    counts = spark.createDataFrame([("Normal", 9), ("Worms", 2), ("DoS", 2)], "class string, n int")
    assert top_attack(counts).first()["top_attack"] == "DoS"


def test_medians_of_clumped_values(spark, monkeypatch):
    """Tiny values beside one that is huge: ranges narrow until the values left are few."""
    import random
    import statistics

    monkeypatch.setattr(stats, "_RANGE_ROWS", 20)
    rng = random.Random(2)
    values = [10 ** rng.uniform(-9, -3) for _ in range(4000)] + [1e9, -1e300, float("inf")]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, k int").repartition(3)
    got = stats.column_medians(df, ["x"]).first()["median"]
    assert got == pytest.approx(statistics.median(values), rel=1e-12)
    for r in stats.column_medians(df, ["x"], ["k"]).collect():
        assert r["median"] == pytest.approx(statistics.median(values[r["k"] :: 2]), rel=1e-12)


CLUMPED = [10 ** random.Random(i).uniform(-9, -3) for i in range(2000)] + [5.0] * 700 + [1e9, -1e300, math.inf]


def test_medians_by_ranges_where_brackets_hold_too_much(spark, monkeypatch):
    monkeypatch.setattr(stats, "_SKETCHED", 4)
    monkeypatch.setattr(stats, "_RANGE_ROWS", 20)
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(CLUMPED)], "x double, k int").repartition(3)
    assert stats.column_medians(df, ["x"]).first()["median"] == median(CLUMPED)
    for r in stats.column_medians(df, ["x"], ["k"]).collect():
        assert r["median"] == median(CLUMPED[r["k"] :: 3])


@pytest.mark.parametrize("lo, hi", [(6.0, 7.0), (-2.0, -1.0), (0.0, 1e-9)])
def test_a_bracket_that_does_not_hold_is_noticed(spark, monkeypatch, lo, hi):
    whole = stats._brackets
    monkeypatch.setattr(stats, "_brackets", lambda *a: whole(*a).withColumns({"lo": F.lit(lo), "hi": F.lit(hi)}))
    assert medians(spark, CLUMPED) == median(CLUMPED)


def test_medians_take_two_scans(spark, monkeypatch, tmp_path):
    """One for the brackets, one for the values inside; results are exact for every key."""
    monkeypatch.setattr(stats, "_SKETCHED", 50)
    df = spark.createDataFrame([(v, -v, i % 3) for i, v in enumerate(CLUMPED)], "x double, y double, k int")
    df.repartition(4).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plans = []
    kept = stats._kept
    monkeypatch.setattr(stats, "_kept", lambda d, n: plans.append(d._jdf.queryExecution().executedPlan().toString()) or kept(d, n))
    monkeypatch.setattr(stats, "_medians_by_ranges", None)
    got = {(r["column"], r["k"]): r["median"] for r in stats.column_medians(stored, ["x", "y"], ["k"]).collect()}
    assert [p.count("FileScan") for p in plans] == [1, 1]
    assert got == {(c, k): s * median(CLUMPED[k::3]) for c, s in (("x", 1), ("y", -1)) for k in range(3)}


def test_approximate_medians(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(999)] + [(None, 0)], "x double, k int")
    got = {r["k"]: r["median"] for r in stats.column_medians(df, ["x"], ["k"], approx=True).collect()}
    assert got == {0: 498.0, 1: 499.0}


def test_medians_and_quantiles_by_points_of_blocks(spark, monkeypatch):
    """Blocks larger than their points: medians stay exact, by a second scan, and quantiles off by few ranks."""
    monkeypatch.setattr(stats, "_POINTS", 64)
    monkeypatch.setattr(stats, "_POINTS_ERROR", 0.02)
    monkeypatch.setattr(stats, "column_medians", None)
    rows = [(float(i * 7919 % 5003) ** 2, None if i % 3 else float(i), None, "x" if i % 5 else str(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, none double, text string").repartition(5)
    got = stats.fit_medians(df, ["a", "b", "none", "text"])
    want = [median(v) for v in ([r[0] for r in rows], [r[1] for r in rows if r[1] is not None], range(0, 5000, 5))]
    assert [got["a"], got["b"], got["text"]] == want and got["none"] is None
    found = stats.quantile_points(df.select("a"), [0.1, 0.5, 0.9])[0]
    ordered = sorted(r[0] for r in rows)
    assert found["n"] == 5000 and found["low"] == ordered[0] and not found["exact"]
    assert all(abs(ordered.index(v) - share * 5000) < 100 for v, share in zip(found["marks"], (0.1, 0.5, 0.9)))


def test_medians_fall_back_where_the_points_do_not_hold(spark, monkeypatch):
    monkeypatch.setattr(stats, "_POINTS", 8)
    monkeypatch.setattr(stats, "_POINTS_ERROR", 0.0)
    df = spark.range(1001).select((F.col("id").cast("double") ** 3).alias("a")).repartition(7)
    assert stats.fit_medians(df, ["a"]) == {"a": 500.0**3}
