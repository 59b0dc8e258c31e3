"""Hot keys: found by a mergeable sketch, and spread without touching the others."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripkit.functions import free_name

# The sketch's counters for each unit of 1/share: its error is then a fraction of the share looked for.
COUNTERS = 32
# Fixed value: the most counters that the sketch takes.
MAX_COUNTERS = 1_000_000


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """``(key, n, share)``: the keys that hold at least ``share`` of the rows, with exact counts, most frequent first.

    A frequent-items sketch finds the candidates: each task keeps a bounded table of counters,
    tables merge into one, and a key with that share can't be missing from it. A second pass
    counts the candidates alone, so what is shuffled is a few rows a task even if all keys are distinct.
    NULL is a key too. Runs when called: the driver sees at most ``2 / share`` candidates. ``share`` is at least 1/31,250.
    """
    if not COUNTERS / MAX_COUNTERS <= share <= 1:
        raise ValueError("share must lie between 1/31,250 and 1")
    top, counters = math.ceil(2 / share), min(COUNTERS * math.ceil(1 / share), MAX_COUNTERS)
    sketch = F.call_function("approx_top_k", F.col(key), F.lit(top), F.lit(max(counters, top)))
    rows, empty, items = df.agg(F.count(F.lit(1)), F.count_if(F.col(key).isNull()), sketch).first()
    named = df.select(key).schema
    found = [(i["item"],) for i in items or [] if i["item"] is not None] + ([(None,)] if empty else [])
    theirs = free_name("candidate", df.columns)
    candidates = df.sparkSession.createDataFrame(found, named).withColumnRenamed(key, theirs)
    counted = (
        df.select(key)
        .join(F.broadcast(candidates), F.col(key).eqNullSafe(F.col(theirs)), "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shared = counted.withColumn("share", F.col("n") / F.lit(max(rows, 1)))
    return shared.where(F.col("n") >= F.lit(share) * rows).orderBy(F.desc("n"), F.asc_nulls_last(key))


def relayout_skewed(df: DataFrame, n: int, key: str, spread: Sequence[str] = (), share: float | None = None) -> DataFrame:
    """Shuffle into ``n`` partitions by ``key``, splitting the hot keys alone.

    A key that holds more than ``share`` of the rows (default: what fills a partition, ``1 / n``)
    goes to as many partitions as its rows fill, by a hash of the ``spread`` columns (default:
    all columns; rows that are alike then stay together, so name an id). All other keys stay whole, in
    one partition each, where a later aggregate finds them without a second look. Runs ``hot_keys`` when called.
    """
    share = share or max(1 / n, COUNTERS / MAX_COUNTERS)
    theirs, salts = free_name("hot_key", df.columns), free_name("salts", df.columns)
    hot = hot_keys(df, key, share).collect()  # at most 1 / share rows
    sizes = [(r[key], min(n, math.ceil(r["share"] / share))) for r in hot]
    table = df.sparkSession.createDataFrame(sizes, df.select(F.col(key).alias(theirs)).schema.add(salts, T.IntegerType()))
    salted = df.join(F.broadcast(table), F.col(key).eqNullSafe(F.col(theirs)), "left").drop(theirs)
    salt = F.pmod(F.xxhash64(*(spread or df.columns)), F.coalesce(salts, F.lit(1)))
    return salted.repartition(n, F.col(key), salt).drop(salts)
