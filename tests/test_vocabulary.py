"""Vocabularies as tables against sorted lists, and against the encoder for small columns."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import encoding, vocabulary
from flowlens.operators.vocabulary import feature_table, fit_vocabulary, slotted_features, with_codes


def mixed(spark, n=4000):
    """One value with half of all rows, many rare ones, missing ones and an empty text; a short column beside it."""
    word = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 1, None).otherwise(F.md5(F.col("id").cast("string")))
    df = spark.range(n).select(
        F.col("id").alias("row"), F.when(F.col("id") == 3, " ").otherwise(word).alias("x_word"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("x_short"), (F.col("id") % 5).cast("double").alias("x_number"),
        F.lit("clash").alias("value"), F.lit("clash").alias("code"), F.lit("clash").alias("column"),
    )
    return df.repartition(7)


@pytest.mark.parametrize("part_values,lookup_rows,hot", [(1_000_000, 50_000, 20_000), (300, 10, 100), (1, 0, 2)])
def test_codes_follow_the_order(spark, monkeypatch, part_values, lookup_rows, hot):
    monkeypatch.setattr(vocabulary, "PART_VALUES", max(part_values, 100))
    monkeypatch.setattr(vocabulary, "HOT_SHARE", hot)
    rows = mixed(spark)
    fitted = fit_vocabulary(rows, ["word", "short"])
    got = rows.collect()
    words = sorted({r["x_word"] for r in got if r["x_word"] is not None})
    assert fitted.sizes == {"word": len(words), "short": 3}
    coded = {r["row"]: (r["word_code"], r["short_code"]) for r in with_codes(rows, fitted, "row", lookup_rows).collect()}
    at = {w: i for i, w in enumerate(words)}
    assert coded == {r["row"]: (at.get(r["x_word"]), int(r["x_short"][1])) for r in got}
    names = {r["slot"]: r["feature"] for r in feature_table(fitted, ["number"]).collect()}
    expected = ["number", *["word_" + ("" if w == " " else w) for w in words], "short_s0", "short_s1", "short_s2"]
    assert names == dict(enumerate(expected, 1))
    long = slotted_features(rows, fitted, ["number"], "row", lookup_rows).collect()
    assert all(names[r["slot"]] == r["feature"] for r in long)
    assert len(long) == sum((r["x_word"] is not None) + 1 + (r["x_number"] != 0) for r in got)


def test_equals_the_encoder(spark):
    rows = mixed(spark).drop("value", "code", "column")
    spec = encoding.FeatureSpec(("number",), ("word", "short"))
    fit, unseen = rows.where("x_short <> 's1'"), rows
    encoder = encoding.fit_one_hot(fit, spec)
    expected = encoding.exploded_features(unseen, encoder, spec, "row")
    got = slotted_features(unseen, fit_vocabulary(fit, ["word", "short"]), ["number"], "row", 100)
    key = lambda df: sorted((r["row"], r["feature"], r["value"]) for r in df.collect())
    assert key(got) == key(expected)
    table = feature_table(fit_vocabulary(fit, ["word", "short"]), ["number"]).orderBy("slot")
    assert [r["feature"] for r in table.collect()] == encoding.feature_columns(encoder, spec)


def test_a_million_values(spark, monkeypatch):
    """More values than a broadcast may hold, in several parts; one value has a third of all rows."""
    monkeypatch.setattr(vocabulary, "PART_VALUES", 200_000)
    n = 1_500_000
    word = F.when(F.col("id") % 3 == 0, "k").otherwise(F.md5(F.col("id").cast("string")))
    rows = spark.range(n).select(F.col("id").alias("row"), word.alias("x_word"))
    fitted = fit_vocabulary(rows, ["word"])
    assert fitted.sizes == {"word": 1_000_001}
    coded = with_codes(rows, fitted, "row")
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan
    facts = coded.agg(
        F.count("word_code").alias("n"), F.countDistinct("word_code").alias("d"), F.max("word_code").alias("top"),
        F.max(F.when(F.col("x_word") == "k", F.col("word_code"))).alias("hot"),
    ).first()
    assert (facts["n"], facts["d"], facts["top"], facts["hot"]) == (n, 1_000_001, 1_000_000, 1_000_000)
    ordered = fitted.codes.select(F.corr(F.conv(F.substring("value", 1, 8), 16, 10).cast("double"), "code")).first()[0]
    assert ordered > 0.999


def test_empty_and_missing(spark):
    rows = mixed(spark, 20)
    none = fit_vocabulary(rows.limit(0), ["word"])
    assert none.sizes == {"word": 0} and feature_table(none).collect() == []
    assert slotted_features(rows, none, [], "row").collect() == []
    assert fit_vocabulary(rows, []).sizes == {}
    blank = rows.withColumn("x_word", F.lit(None).cast("string"))
    assert fit_vocabulary(blank, ["word"]).sizes == {"word": 0}
