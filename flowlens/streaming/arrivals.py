"""Scoring captures as they arrive in a folder: the same models, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions import domain, text
from flowlens.operators.drift import drift
from flowlens.operators.schema import normalize_columns, require_columns
from flowlens.plans.recipes import Trained
from flowlens.plans.scoring import score_intrusion


def captures_stream(spark: SparkSession, folder: str, header: Sequence[str]) -> DataFrame:
    """New ``*.csv`` files of one header as a stream of text columns.

    A file whose header differs, be it in the order of its columns only, stops the stream.
    """
    schema = ", ".join(f"`{name}` string" for name in header)
    options = {"header": "true", "enforceSchema": "false", "escape": '"', "pathGlobFilter": "*.csv"}
    rows = spark.readStream.schema(schema).options(**options).csv(folder)
    named = normalize_columns(rows)
    return named.select(*[text.null_on_read(F.col(c)).alias(c) for c in named.columns])


def score_arrivals(
    flows: DataFrame, trained: Trained, output: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Score each batch, write it to ``output/predictions`` and its drift verdict to ``output/drift``.

    A batch writes folders named after its number and overwrites them, so a batch repeated after a
    failure leaves one copy. Missing numbers take the stored medians: a stream has no whole table
    to take a median of.
    """
    require_columns(flows, domain.INTRUSION_COLUMNS, "capture stream")
    scored = score_intrusion(flows, trained, impute_from="train")

    def store(batch: DataFrame, number: int) -> None:
        place = f"{output.rstrip('/')}/predictions/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        # The verdict reads what was written, so the model runs once per batch.
        written = batch.sparkSession.read.schema(batch.schema).parquet(place)
        verdict = drift(trained.distribution, written, trained.recipe.output)
        verdict.write.mode("overwrite").parquet(f"{output.rstrip('/')}/drift/batch={number}")

    writer = scored.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
