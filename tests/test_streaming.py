import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlens.functions import domain
from flowlens.plans import recipes
from flowlens.plans.scoring import score_intrusion
from flowlens.sources.sinks import write_clean
from flowlens.operators.drift import drift
from flowlens.streaming.arrivals import captures_stream, score_arrivals
from flowlens.streaming.windows import drift_windows


def test_arrivals_are_scored_once(spark, tmp_path, tables):
    trained = recipes.train(recipes.RECIPES["forest_baseline"], tables.cleaned, numTrees=3, maxDepth=4)
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    columns = ["flow_id", *domain.INTRUSION_COLUMNS]
    rows = tables.flows.select(*columns)

    def run():
        query = score_arrivals(captures_stream(spark, f"{landing}/*", columns), trained, out, state)
        query.awaitTermination(120)
        assert query.exception() is None
        return spark.read.parquet(f"{out}/predictions")

    write_clean(rows.where("flow_id % 2 = 0"), f"{landing}/a", "csv")
    assert run().count() == rows.where("flow_id % 2 = 0").count()
    write_clean(rows.where("flow_id % 2 = 1"), f"{landing}/b", "csv")
    got = run()
    assert got.count() == rows.count() and got.select("batch").distinct().count() == 2
    assert spark.read.parquet(f"{out}/drift").count() == 2

    # Batch scoring of the same rows with stored medians gives the same predictions.
    batch = score_intrusion(rows, trained, impute_from="train").select(F.col("flow_id").cast("string"), "predicted_attack")
    assert batch.exceptAll(got.select("flow_id", "predicted_attack")).isEmpty()


def test_columns_in_another_order_stop_the_stream(spark, tmp_path):
    write_clean(spark.createDataFrame([("1", "2")], "b string, a string"), f"{tmp_path}/in", "csv")
    rows = captures_stream(spark, f"{tmp_path}/in", ["a", "b"])
    query = rows.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    with pytest.raises(StreamingQueryException):
        query.awaitTermination(60)


def test_windows_close_whole_and_drop_late_rows(spark, tmp_path):
    """Minutes of event time over four arrivals: verdicts of closed windows equal those over all rows in time."""
    trained = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "class string, share double")
    schema = "second int, k string, y string"
    arrivals = [
        [(5, "p", "a"), (30, "p", "b"), (59, "q", "a"), (61, "p", "c"), (None, "p", "a"), (10, "p", None)],
        [(50, "p", "a"), (119, "q", "b"), (150, "p", "a")],  # 50 is late, but within the delay
        [(20, "p", "b"), (190, "p", "a")],  # 20 is of a window that is closed
        [(400, "q", "a")],
    ]
    out, state, landing = (str(tmp_path / n) for n in ("out", "state", "landing"))
    for number, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{landing}/{number}")
        stream = spark.readStream.schema(schema).parquet(f"{landing}/*")
        timed = stream.withColumn("time", F.timestamp_seconds("second"))
        query = drift_windows(timed, trained, out, state, "y", "time", "1 minute", "30 seconds", by=["k"])
        query.awaitTermination(120)
        assert query.exception() is None
    whole = spark.createDataFrame([r for rows in arrivals for r in rows if r[0] not in (20, 400)], schema)
    keyed = whole.where("second is not null and y is not null").withColumn("start", F.expr("second div 60 * 60"))
    expected = {(r["start"], r["k"]): r["js_distance"] for r in drift(trained, keyed, "y", by=["start", "k"]).collect()}
    got = spark.read.parquet(f"{out}/drift").select(F.unix_seconds("window_start").alias("start"), "k", "js_distance").collect()
    assert {(r["start"], r["k"]): r["js_distance"] for r in got} == pytest.approx(expected)
    assert len(got) == len(expected)  # no window comes out twice
    counts = spark.read.parquet(f"{out}/windows")
    assert counts.agg(F.sum("n")).first()[0] == 8


def test_scored_arrivals_are_judged_by_window(spark, tmp_path, tables):
    """The scoring of a stream feeds the windows: counts are those of scoring the same rows at once."""
    trained = recipes.train(recipes.RECIPES["forest_baseline"], tables.cleaned, numTrees=3, maxDepth=4)
    columns = ["flow_id", *domain.INTRUSION_COLUMNS]
    rows = tables.flows.select(*columns)
    landing, out, state = (str(tmp_path / n) for n in ("landing", "out", "state"))
    write_clean(rows, landing, "csv")
    stamp = F.timestamp_seconds(F.col("flow_id").cast("long")).alias("time")
    scored = score_intrusion(captures_stream(spark, landing, columns), trained, impute_from="train").select("*", stamp)
    query = drift_windows(scored, trained.distribution, out, state, trained.recipe.output, "time", "100 seconds", "0 seconds")
    query.awaitTermination(120)
    assert query.exception() is None
    last = rows.agg(F.max("flow_id")).first()[0]
    batch = score_intrusion(rows, trained, impute_from="train").withColumn("start", F.expr("flow_id div 100 * 100"))
    expected = batch.where(F.col("start") + 100 <= last).groupBy("start", F.col("predicted_attack").alias("class")).count()
    got = spark.read.parquet(f"{out}/windows").select(F.unix_seconds("window_start").alias("start"), "class", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
