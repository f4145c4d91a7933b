"""Drift per window of event time, over rows as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions import domain
from flowlens.operators.drift import drift_of_counts

WINDOW = ("window_start", "window_end")


def windowed_class_counts(
    rows: DataFrame, column: str, time: str, width: str = "1 hour", delay: str = "10 minutes", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per window, key and class (``n``). State holds the counts of open windows only.

    A window is closed, and its counts come out, once rows later than its end by ``delay`` have arrived;
    rows of a closed window that come later still are dropped. Rows without a time or a class take no part.
    """
    timed = rows.where(F.col(time).isNotNull() & F.col(column).isNotNull()).withWatermark(time, delay)
    window = F.window(time, width)
    counted = timed.groupBy(window.alias("__window"), *by, F.col(column).alias("class")).agg(F.count("*").alias("n"))
    start, end = (F.col(f"__window.{edge}").alias(name) for edge, name in zip(("start", "end"), WINDOW))
    return counted.select(start, end, *by, "class", "n")


def drift_windows(
    rows: DataFrame,
    distribution: DataFrame,
    output: str,
    checkpoint: str,
    column: str,
    time: str,
    width: str = "1 hour",
    delay: str = "10 minutes",
    by: Sequence[str] = (),
    threshold: float = domain.DRIFT_THRESHOLD,
    available_now: bool = True,
) -> StreamingQuery:
    """Write the class counts of each closed window to ``output/windows`` and its verdict to ``output/drift``.

    ``rows`` is a stream with a class column, as the scoring of arrivals gives it, and a timestamp. All classes
    of a window close in the same batch, so a verdict has the whole window. A batch writes folders named after
    its number and overwrites them: repeated after a failure, it leaves one copy.
    """
    counts = windowed_class_counts(rows, column, time, width, delay, by)

    def store(batch: DataFrame, number: int) -> None:
        place = f"{output.rstrip('/')}/windows/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        closed = batch.sparkSession.read.schema(batch.schema).parquet(place)
        verdict = drift_of_counts(distribution, closed, threshold, [*WINDOW, *by])
        verdict.write.mode("overwrite").parquet(f"{output.rstrip('/')}/drift/batch={number}")

    writer = counts.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
