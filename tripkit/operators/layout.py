"""Physical layout: partitions, caching and reliable checkpoints."""

from __future__ import annotations

import re
import weakref
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripkit.functions import free_name

# monotonically_increasing_id() keeps the row number within its partition in the low 33 bits.
_ROW_BITS = 33


def partition_profile(df: DataFrame, empty: bool = False) -> DataFrame:
    """``(partition_id, n)``: rows in each partition, which shows skew at a glance.

    With ``empty`` partitions without rows are listed too; their number is taken from the plan
    when this is called.
    """
    counts = df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("n"))
    if not empty:
        return counts
    every = df.sparkSession.range(partition_count(df)).select(F.col("id").cast("int").alias("partition_id"), F.lit(0).cast("long").alias("n"))
    return every.unionAll(counts).groupBy("partition_id").agg(F.sum("n").alias("n"))


def partition_count(df: DataFrame) -> int:
    """Number of partitions, empty ones included. A frame with shuffles is computed up to the last one."""
    return df.rdd.getNumPartitions()


def relayout(
    df: DataFrame,
    n: int | None = None,
    *keys: str,
    salts: int | None = None,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Shuffle into partitions of the advisory size, or into exactly ``n``: evenly, or by ``keys``.

    ``relayout_skewed`` finds the hot keys itself and splits those alone.

    Without ``n`` Spark rebalances: it sees the sizes after the shuffle, merges small partitions
    and splits large ones, a hot key's too. That is the choice for large inputs.

    With ``n``, dealing rows out evenly makes Spark sort them first, so that a task that runs
    again deals the same way. Naming id columns in ``spread`` places rows by their hash
    instead, which needs no sort. With keys, each key goes to up to ``salts`` partitions
    (default: all ``n``), chosen by a hash of the ``spread`` columns (default: the whole row;
    rows that are alike then stay together, so name an id), so that one very frequent key
    does not end up in few tasks. ``salts=1`` co-locates every key, for keys known to be even.
    """
    if n is None:
        return df.hint("rebalance", *keys)
    if not keys:
        return df.repartition(n, *(spread or ()))
    salts = n if salts is None else salts
    placement: list[Column] = [F.col(key) for key in keys]
    if salts > 1:
        placement.append(F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(salts)))
    return df.repartition(n, *placement)


def held(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep ``df`` for lazy results that several consumers make of it.

    Whoever uses the results releases it with ``unpersist()``, or hands the release to one of
    them with ``release_with``.
    """
    return df.persist(level)


def release_with(result: DataFrame, kept: DataFrame) -> DataFrame:
    """``result``, which on its end (when nothing refers to it) releases ``kept``."""
    weakref.finalize(result, kept.unpersist)
    return result


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep ``df`` for several actions inside the block and release it afterwards.

    Select the needed columns first: the cache holds every column of ``df``. A frame that the
    caller has already persisted is used as it is and left persisted.
    """
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        yield df
        return
    held = df.persist(level)
    try:
        yield held
    finally:
        held.unpersist()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's ``spark.checkpoint.dir``.

    Where that is unset, a folder in the session's warehouse. On a cluster a warehouse on a
    machine's own disk is refused, because other executors could not read it. Checkpoint files go away with their frames if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not folder and not context.master.startswith("local") and re.match(r"file:|/", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, store it in the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_position(df: DataFrame, *order: Column, out: str) -> DataFrame:
    """Add the 0-based position of each row in the total order, without one task seeing all rows.

    The rows are range-sorted and checkpointed, which fixes their partitions. A row's position
    is its place in its partition plus the sizes of the partitions before it. The size table
    has one row per partition, which bounds both its window and its broadcast.
    """
    row, part, place, size, offset = (free_name(name, df.columns) for name in ("row", "part", "place", "size", "offset"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    placed = checkpointed(df.orderBy(*order)).withColumn(row, F.monotonically_increasing_id())
    placed = placed.select(
        *kept,
        F.shiftright(row, _ROW_BITS).alias(part),
        F.col(row).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(place),
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part)
        .agg(F.count(F.lit(1)).alias(size))
        .select(part, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(offset))
    )
    return placed.join(F.broadcast(offsets), part).select(*kept, (F.col(offset) + F.col(place)).alias(out))
