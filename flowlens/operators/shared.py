"""Size-checked lookups and stable hashing shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup of at most this many rows may be held by the driver and broadcast.
LOOKUP_ROWS = 50_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}
# Copies of one row that a single array may enumerate.
COPIES_PER_BLOCK = 10_000


def ship_with_tasks(module: str) -> None:
    """Send a module's functions to the Python workers along with the task.

    Workers then need numpy and pandas, but no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def collect_lookup(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> list | None:
    """Rows of ``df`` when there are at most ``max_rows`` of them, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def checked_lookup(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """``df`` as a broadcast of proven size; unchanged, for a shuffle join, when it is larger."""
    rows = collect_lookup(df, max_rows)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the lookup's key columns are not repeated."""
    renamed = lookup.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in lookup.columns])
    match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    if how in ("left_semi", "left_anti"):
        return df.join(renamed, match, how)
    return df.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def hash_key(seed: int | str, *parts: Column | str) -> Column:
    """Hex digest that orders rows pseudo-randomly, alike for every partitioning."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))


def hash_fraction(key: Column, start: int = 1) -> Column:
    """Number in [0, 1) from eight hex digits of a digest."""
    return hash_integer(key, start) / F.lit(4294967296.0)


def hash_integer(key: Column, start: int = 1) -> Column:
    return F.conv(F.substring(key, start, 8), 16, 10).cast("bigint")


def repeat_rows(df: DataFrame, copies: Column, index: str, row_id: str, most: int) -> DataFrame:
    """Emit each row ``copies`` times, numbered from 0 in ``index``; ``most`` bounds the copies.

    A row with very many copies is first cut into blocks that are spread over the tasks, so
    neither one array nor one task has to hold all of them.
    """
    counted = df.withColumn("__copies", copies.cast("bigint"))
    zero = F.lit(0).cast("bigint")
    plain = counted.where(F.col("__copies").between(1, COPIES_PER_BLOCK)).withColumn(
        index, F.explode(F.sequence(zero, F.col("__copies") - 1))
    )
    if most <= COPIES_PER_BLOCK:
        return plain.drop("__copies")
    starts = F.sequence(zero, F.col("__copies") - 1, F.lit(COPIES_PER_BLOCK).cast("bigint"))
    blocks = (
        counted.where(F.col("__copies") > COPIES_PER_BLOCK)
        .withColumn("__start", F.explode(starts))
        # A stated number of partitions: by their bytes these few rows would be put into one.
        .repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(row_id), F.col("__start"))
    )
    last = F.least(F.col("__start") + COPIES_PER_BLOCK, F.col("__copies")) - 1
    spread = blocks.withColumn(index, F.explode(F.sequence(F.col("__start"), last))).drop("__start")
    return plain.unionByName(spread).drop("__copies")


def checkpoint_folder(spark) -> str:
    """Shared scratch folder of the cluster, as the session names it.

    Only a local session, which is its own cluster, gets a folder by itself if none is named; that one
    goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="flowlens-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[application], ignore_errors=True)
    return _LOCAL_FOLDERS[application]


def scratch_path(spark, name: str) -> str:
    """A new path in the shared folder, below this application's own part of it."""
    return f"{checkpoint_folder(spark)}/flowlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark) -> None:
    """Delete what this application has written to the shared folder: the last step of a job.

    Tables that were read from there can no longer be used.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_folder(spark)}/flowlens/{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark) -> Iterator[None]:
    """Queries built and run inside delete their shuffle files as soon as they end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame, together: Sequence[Column | str] = ()) -> DataFrame:
    """``df`` dealt evenly to a few tasks per core, rows that agree on ``together`` to the same one.

    Rows that much is computed from take few bytes: as many tasks as their files suggest would leave cores idle.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *together)


def written_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: durable, columnar lineage cut."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
