"""Longest-processing-time sharding of documents, with copies of one text kept together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import written_table

ROW_BYTES = 16
# Groups above 1/LARGE of a shard's share are scheduled one by one: fewer than shards * LARGE of them.
LARGE = 64
# All smaller groups are gathered into this many bundles, which are scheduled like groups.
BUNDLES = 8192
CELL_ROWS = 10_000


def longest_first(items: list[tuple[str, int]], shards: int) -> list[tuple[str, int]]:
    """Longest-processing-time schedule: largest item first, each to the least-loaded shard.

    Ties go by item name and by shard number. Returns (item, shard).
    """
    loads = [(0, s) for s in range(shards)]
    out = []
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        out.append((name, shard))
        heapq.heappush(loads, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and place in the shard of every document, shard sizes in bytes being near equal.

    A document's size is the UTF-8 bytes of its text plus 16. Documents with equal texts form a group
    and share a shard. The driver's heap holds at most shards * 64 large groups and 8192 bundles of
    the other groups (chosen by a digest of the text), whatever the input; so shards differ by about
    one bundle, unless a single group exceeds a shard's share. Returns doc_id, size, text_crc32,
    shard and slot, which numbers each shard's documents from 0 without gaps.

    A null text counts as empty. Rows without id and repeated rows are placed like any other, each in
    a slot of its own. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = written_table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("text_key"),
        ),
        "sized",
    )
    total, rows = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    groups = sized.groupBy("text_key").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") * shards * LARGE > total
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES)).cast("string"))
    items = (
        groups.groupBy(F.when(large, F.hex("text_key")).otherwise(bundle).alias("item"))
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # fewer than shards * LARGE + BUNDLES rows
    )
    schedule = spark.createDataFrame(
        longest_first([(r["item"], r["bytes"]) for r in items], shards), "name string, shard int"
    )
    alone = schedule.where("name not like 'bundle %'").select(F.unhex("name").alias("own_key"), F.col("shard").alias("own"))
    placed = (
        sized.join(F.broadcast(alone), F.col("text_key") == F.col("own_key"), "left")
        .join(F.broadcast(schedule), bundle == F.col("name"), "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("own", "shard").alias("shard"),
            F.pmod(
                F.xxhash64("doc_id", "text_crc32"), F.lit(max(32, rows // (shards * CELL_ROWS))).cast("long")
            ).alias("cell"),
        )
    )
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        F.col("shard").alias("of_shard"),
        F.col("cell").alias("of_cell"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(offsets, (F.col("shard") == F.col("of_shard")) & (F.col("cell") == F.col("of_cell")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))
    )
