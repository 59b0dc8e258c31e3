"""The calendar panel: every key at every hour of every day, with zeros."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripkit.functions import day_name, free_name, hour_of_day, weekend_flag
from tripkit.operators.layout import checkpointed


def demand_panel(df: DataFrame, key: str, ts: str, count_as: str = "n", date_as: str = "date") -> DataFrame:
    """``(key, date, pickup_hour, day_of_week, is_weekend, count)``: one row per key, date and hour.

    The dates run from the first to the last of the table without gaps, and cells without rows
    count zero. Rows with a NULL timestamp are in no cell; a NULL key is a key. A table without
    rows has no cells.

    Runs when called: rows are counted once and checkpointed; keys, dates and counts come
    from there. The empty cells are generated beside the counts and added up with them, so there
    is one shuffle of cells and no join.
    """
    day, hour, n = date_as, "pickup_hour", count_as
    timed = df.where(F.col(ts).isNotNull())
    counts = checkpointed(
        timed.groupBy(F.col(key), F.to_date(ts).alias(day), hour_of_day(ts).alias(hour)).agg(F.count(F.lit(1)).alias(n))
    )
    span = counts.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = F.explode(F.sequence(span.select("first").scalar(), span.select("last").scalar())).alias(day)
    hours = F.explode(F.sequence(F.lit(0), F.lit(23))).alias(hour)
    cells = counts.select(key).distinct().select(key, days).select("*", hours).withColumn(n, F.lit(0).cast("long"))
    filled = cells.unionByName(counts).groupBy(key, day, hour).agg(F.sum(n).alias(n))
    return filled.select(key, day, hour, day_name(day).alias("day_of_week"), weekend_flag(day).alias("is_weekend"), n)


def time_split(panel: DataFrame, pct: int = 80, date_as: str = "date") -> tuple[DataFrame, DataFrame]:
    """``(earlier, later)``: the first ``pct`` percent of the days, and the rest.

    A model of demand is asked about days it has not seen, so whole days are held out. The
    driver sees the first and the last date. At least one day is earlier.
    """
    first, last = panel.agg(F.min(date_as), F.max(date_as)).first()
    if first is None:
        return panel, panel
    cut = date.fromordinal(first.toordinal() + max(1, ((last - first).days + 1) * pct // 100))
    return panel.where(F.col(date_as) < F.lit(cut)), panel.where(F.col(date_as) >= F.lit(cut))


def cell_means(train: DataFrame, cells: DataFrame, keys: list[str], label: str, out: str) -> DataFrame:
    """``cells`` with the mean of their like among ``train`` (equal ``keys``), NULL if there is none."""
    theirs = {name: free_name(f"their_{name}", cells.columns) for name in keys}
    means = train.groupBy(*keys).agg(F.avg(label).alias(out)).withColumnsRenamed(theirs)
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in theirs.items()]
    return cells.join(means, same, "left").drop(*theirs.values())
