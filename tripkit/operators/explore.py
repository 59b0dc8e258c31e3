"""Grouped aggregates, hour-of-day reports and top-k.

Every group-by here aggregates partially before its shuffle, so a very frequent key adds one
small record per task. Every ranking names the key last, so ties have one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripkit.functions import day_name, free_name, hour_of_day, weekend_flag
from tripkit.operators.layout import with_position


# Weekday names.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _n():
    return F.count(F.lit(1)).alias("n")


def distribution(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` in key order; NULL is a group of its own, listed first."""
    return df.groupBy(key).agg(_n()).orderBy(F.asc_nulls_first(key))


def _by_hour(df: DataFrame, ts: str, out: str):
    return df.groupBy(hour_of_day(ts).alias(out))


def count_by_hour(df: DataFrame, ts: str, out: str = "pickup_hour") -> DataFrame:
    """``(hour, n)``, busiest hour first."""
    return _by_hour(df, ts, out).agg(_n()).orderBy(F.desc("n"), F.asc(out))


def peak_hour(df: DataFrame, ts: str, out: str = "pickup_hour") -> DataFrame:
    """The busiest hour and its count; the earlier hour wins a tie."""
    return count_by_hour(df, ts, out).limit(1)


def avg_by_hour(
    df: DataFrame, ts: str, measure: str, out: str = "pickup_hour", avg_as: str | None = None
) -> DataFrame:
    """``(hour, avg)``, highest average first."""
    avg_as = avg_as or f"avg_{measure}"
    return (
        _by_hour(df, ts, out)
        .agg(F.avg(measure).alias(avg_as))
        .orderBy(F.desc_nulls_last(avg_as), F.asc(out))
    )


def peak_avg_hour(
    df: DataFrame, ts: str, measure: str, out: str = "pickup_hour", avg_as: str | None = None
) -> DataFrame:
    """The hour with the highest average; the earlier hour wins a tie."""
    return avg_by_hour(df, ts, measure, out, avg_as).limit(1)


def topk_by_count(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent keys."""
    return df.groupBy(key).agg(_n()).orderBy(F.desc("n"), F.asc_nulls_last(key)).limit(k)


def topk_by_sum(df: DataFrame, key: str, measure: str, k: int = 10, sum_as: str = "total") -> DataFrame:
    """The ``k`` keys with the largest sum of ``measure``."""
    return (
        df.groupBy(key)
        .agg(F.sum(measure).alias(sum_as))
        .orderBy(F.desc_nulls_last(sum_as), F.asc_nulls_last(key))
        .limit(k)
    )


def avg_by_key(df: DataFrame, key: str, measure: str, avg_as: str | None = None) -> DataFrame:
    """``(key, avg)``, unordered."""
    return df.groupBy(key).agg(F.avg(measure).alias(avg_as or f"avg_{measure}"))


def demand_table(df: DataFrame, key: str, ts: str, count_as: str = "n") -> DataFrame:
    """Rows per key, hour of day, weekday and weekend flag; empty cells are absent."""
    return df.groupBy(
        key,
        hour_of_day(ts).alias("pickup_hour"),
        day_name(ts).alias("day_of_week"),
        weekend_flag(ts).alias("is_weekend"),
    ).agg(F.count(F.lit(1)).alias(count_as))


def demand_table_filled(df: DataFrame, key: str, ts: str, count_as: str = "n") -> DataFrame:
    """The demand table with all 24 x 7 cells of every key, zeros included, and counts per day.

    ``days`` is how often the weekday occurs among the days of the table, and ``per_day`` the
    count divided by it, so that a fifth Monday of a month does not look like more demand. Rows
    with a NULL timestamp are in no cell. The weekdays' days are seven rows.
    """
    timed = df.where(F.col(ts).isNotNull())
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("pickup_hour")
    day = F.explode(F.array(*map(F.lit, WEEKDAYS))).alias("day_of_week")
    cells = timed.select(key).distinct().select(key, hours).select("*", day)
    days = (
        timed.select(F.to_date(ts).alias("date")).distinct().groupBy(day_name("date").alias("day_of_week")).agg(
            F.count(F.lit(1)).alias("days")
        )
    )
    theirs = {name: free_name(f"their_{name}", [key, count_as]) for name in (key, "pickup_hour", "day_of_week")}
    counts = demand_table(timed, key, ts, count_as).withColumnsRenamed(theirs)
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in theirs.items()]
    filled = cells.join(counts.drop("is_weekend"), same, "left").join(F.broadcast(days), "day_of_week", "left")
    n = F.coalesce(count_as, F.lit(0))
    return filled.select(
        key,
        "pickup_hour",
        "day_of_week",
        F.when(F.col("day_of_week").isin("Sat", "Sun"), 1).otherwise(0).alias("is_weekend"),
        n.alias(count_as),
        F.coalesce("days", F.lit(0)).alias("days"),
        F.try_divide(n.cast("double"), F.col("days").cast("double")).alias("per_day"),
    )


def weekend_split(df: DataFrame, ts: str, measure: str, avg_as: str | None = None) -> DataFrame:
    """``(is_weekend, n, avg)``: weekdays against weekends."""
    return df.groupBy(weekend_flag(ts).alias("is_weekend")).agg(
        _n(), F.avg(measure).alias(avg_as or f"avg_{measure}")
    )


def revenue_vs_volume(
    df: DataFrame, key: str, measure: Column | str, sum_as: str = "total"
) -> DataFrame:
    """``(key, n, total, volume_rank, revenue_rank)``: each key's place by count and by sum.

    One aggregation feeds both rankings; ranks start at 1 and ties follow the key. Runs when
    called. Cast a money measure to decimal where equal totals must compare as equal.
    """
    per_key = df.groupBy(key).agg(_n(), F.sum(measure).alias(sum_as))
    by_volume = with_position(per_key, F.desc("n"), F.asc_nulls_last(key), out="volume_rank")
    by_both = with_position(
        by_volume, F.desc_nulls_last(sum_as), F.asc_nulls_last(key), out="revenue_rank"
    )
    return by_both.withColumns(
        {rank: F.col(rank) + 1 for rank in ("volume_rank", "revenue_rank")}
    )


def category_index(df: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """``(column, idx)``: categories numbered from 0 by falling frequency, ties by name.

    The same numbers as a fitted ``StringIndexer``, but as a table and without
    gathering the categories on the driver. Runs when called.
    """
    per_value = df.where(F.col(column).isNotNull()).groupBy(column).agg(_n())
    numbered = with_position(per_value, F.desc("n"), F.asc(column), out=out)
    return numbered.select(column, F.col(out).cast("double").alias(out))
