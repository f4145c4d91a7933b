"""Quality selection by importance resampling over hashed n-gram models.

Two generative models over hashed features, one of target text and one of all text, give each
document the log-ratio of its probabilities. Gumbel noise, keyed by document, is added, and the k
documents with the largest sums are a sample without replacement by importance weight. Features
are words, pairs of words, runs of symbols and immediate repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.hashing import byte_codes, mix, pieces, string_parts, window_hashes, word_hashes
from flowlens.operators.shared import ship_with_tasks, written_table

for _module in (__name__, "flowlens.llm.hashing"):
    ship_with_tasks(_module)

WORD_BUCKETS, PAIR_BUCKETS = 1 << 20, 1 << 18
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS
MAX_LABELS = 200_000
PSEUDO_COUNT = 0.05
DEVIATIONS = 2.0
BINS = 4096
LAST_ROWS = 10_000


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece of a column: first row, feature buckets, and the row in the piece of each."""
    plain = [chr(i).isalnum() for i in range(128)]
    spaces = [chr(i).isspace() for i in range(128)]
    words_of = byte_codes(bytes(i for i in range(128) if not plain[i]), lower=True)
    symbols_of = byte_codes(bytes([i for i in range(128) if plain[i] or spaces[i]] + list(range(128, 256))))
    data, offsets = string_parts(column)
    for first, last in pieces(offsets):
        part, own = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        words, firsts = word_hashes(part, own, words_of)
        row = np.repeat(np.arange(last - first), np.diff(firsts))
        pairs = window_hashes(words, 2)
        if len(pairs):
            pairs[words[1:] == words[:-1]] = 0  # a repeat counts as such, whatever the word
        inside = row[1:] == row[:-1]
        symbols, firsts = word_hashes(part, own, symbols_of)
        symbol_row = np.repeat(np.arange(last - first), np.diff(firsts))
        rest = np.concatenate([pairs[inside], mix(symbols + np.uint64(1))]) % np.uint64(PAIR_BUCKETS)
        found = np.concatenate([words % np.uint64(WORD_BUCKETS), rest + np.uint64(WORD_BUCKETS)])
        yield first, found.astype(np.int64), np.concatenate([row, row[1:][inside], symbol_row])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature counts of one task: over all rows, and over the rows marked as target."""
    everything, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        marked = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        for first, found, row in features(batch.column(0)):
            everything += np.bincount(found, minlength=BUCKETS)
            target += np.bincount(found[marked[first + row]], minlength=BUCKETS)
    some = np.flatnonzero(everything)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(everything[some]), pa.array(target[some])], ["bucket", "n", "n_target"]
    )


def _weigh(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, found, row in features(batch.column(2)):
                size = int(row.max()) + 1 if len(row) else 0
                n[first : first + size] += np.bincount(row, minlength=size)
                total[first : first + size] += np.bincount(row, weights=ratios.value[found], minlength=size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(total)],
                ["doc_id", "text_key", "n_features", "log_weight"],
            )

    return run


def gumbel(seed: int, *key: Column) -> Column:
    """Standard Gumbel noise as a function of the key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """Exactly the k-th largest value of a column, by counting in ever narrower bins.

    The driver sees ``BINS`` counts per pass and at most ``LAST_ROWS`` values at the end.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    value, left = F.col(column), k
    while True:
        inside = df.where(value.between(low, high))
        if n <= LAST_ROWS or low == high:
            rows = inside.select(column).orderBy(value.desc()).limit(min(left, LAST_ROWS)).collect()
            return rows[-1][0]
        at = F.least(F.floor((value - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        counts = (
            inside.groupBy(at.alias("bin"))
            .agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for row in counts:
            if left <= row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            left -= row["n"]


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    keep: float | None = None,
    seed: int = 0,
    max_labels: int = MAX_LABELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Log importance weight of every document, and whether the sample keeps it.

    ``labels`` has the id and a boolean ``target``. At most ``max_labels`` labelled ids, chosen by
    hash, fit the target model; the model of all text and the selection cover every document. The
    sample keeps the share ``keep`` of all documents, by default the share of target among the
    labelled ones. A bucket counts only where its target count is more than two standard deviations
    off what all text makes expect, so rare words add no noise. Returns doc_id, text_key (hash of the
    text), n_features, log_weight and kept.

    Null and empty texts have weight 0 and are drawn by their noise alone, as are all texts if nothing
    is labelled (then all are kept). An id labelled twice is target if all its labels say so; null
    labels are ignored. Rows with equal id and text share their noise and so their fate. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col("target").isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("labelled"))
        .agg(F.min("target").alias("target"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(max_labels)
    )
    known = written_table(known, "labels")
    share = known.agg(F.avg(F.col("target").cast("double"))).first()[0]
    marked = base.join(F.broadcast(known), base["doc_id"] == known["labelled"], "left")
    counts = written_table(
        marked.select("text", "target")
        .mapInArrow(_count, "bucket long, n long, n_target long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")),
        "feature-counts",
    )
    n, n_target = counts.agg(F.sum("n"), F.sum("n_target")).first()
    ratios = np.zeros(BUCKETS, np.float32)
    if n_target:
        expected = F.col("n") * (n_target / n)
        off = F.abs(F.col("n_target") - expected) / F.sqrt(expected + 1)
        ratio = F.log((F.col("n_target") + PSEUDO_COUNT) / (expected + PSEUDO_COUNT))
        told = counts.where(off > DEVIATIONS).select("bucket", ratio.alias("ratio")).toArrow()  # at most BUCKETS rows
        ratios[told.column("bucket").to_numpy()] = told.column("ratio").to_numpy()
    shared = spark.sparkContext.broadcast(ratios)
    weighed = base.mapInArrow(_weigh(shared), "doc_id long, text_key long, n_features long, log_weight double")
    scores = written_table(
        weighed.withColumn("key", F.col("log_weight") + gumbel(seed, F.col("doc_id"), F.col("text_key"))), "weights"
    )
    shared.destroy()
    wanted = keep if keep is not None else share
    k = math.floor((1.0 if wanted is None else wanted) * scores.count() + 0.5)
    kept = F.col("key") >= kth_largest(scores, "key", k) if k else F.lit(False)
    return scores.select("doc_id", "text_key", "n_features", "log_weight", kept.alias("kept"))
