"""Stored moments: reports over many months without reading the trips again.

A state has one row per month, key and measure: rows, known values, their sum, their sum of
squared deviations from the mean, minimum and maximum. States of disjoint rows combine into the
state of their union, so adding a month means computing that month's state alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripkit.functions import as_column, free_name
from tripkit.operators.encoding import by_size
from tripkit.operators.layout import checkpointed

# The columns of a state beside its keys.
STATE = ("measure", "rows", "n", "total", "m2", "low", "high")


def moments(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The state of ``df``: ``(keys..., measure, rows, n, total, m2, low, high)``, one row per key and measure.

    NULL measures count in ``rows`` only; a NULL key is a key. One aggregation for all measures. NaN makes
    a state's sums NaN, as it does in the reports themselves.
    """

    def state(name: str) -> Column:
        x = F.col(name).cast("double")
        n = F.count(x)
        return F.struct(
            F.lit(name).alias("measure"),
            F.count(F.lit(1)).alias("rows"),
            n.alias("n"),
            F.sum(x).alias("total"),
            (F.var_pop(x) * n).alias("m2"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
        )

    states = [f"state_{i}" for i in range(len(measures))]
    wide = df.groupBy(*keys).agg(*[state(m).alias(s) for m, s in zip(measures, states, strict=True)])
    return wide.select(*keys, F.inline(F.array(*states)))


def month_of(ts: Column | str) -> Column:
    """``yyyy-MM``, the name of a month."""
    return F.date_format(as_column(ts), "yyyy-MM")


def month_moments(df: DataFrame, ts: str, key: str, measures: Sequence[str], month_as: str = "month") -> DataFrame:
    """The state per month and key, for ``store_months`` beside the trips or in their place."""
    return moments(df.withColumn(month_as, month_of(ts)), [month_as, key], measures)


def merge_moments(state: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The state of the same rows by fewer keys.

    The mean of each new group comes first, then the deviations are moved to it, so that no large
    numbers are subtracted from one another. Both are aggregates of one row per old group.
    Runs when called: the means are stored and joined in by size.
    """
    by = [*keys, "measure"]
    totals = state.groupBy(*by).agg(F.sum("n").alias("all_n"), F.sum("total").alias("all_total"))
    theirs = {name: free_name(f"their_{name}", state.columns) for name in by}
    means = checkpointed(totals.select(*[F.col(c).alias(t) for c, t in theirs.items()], F.try_divide("all_total", "all_n").alias("all_mean")))
    same = [F.col(c).eqNullSafe(F.col(t)) for c, t in theirs.items()]
    off = F.try_divide("total", "n") - F.col("all_mean")
    return (
        state.join(by_size(means), same)
        .groupBy(*by)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
    )


def _mean() -> Column:
    return F.try_divide("total", "n")


def _deviation() -> Column:
    return F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))


def summarize_state(state: DataFrame) -> DataFrame:
    """What ``summarize`` gives for the rows behind a state: ``(column, n, mean, stddev, min, max)``."""
    return merge_moments(state).select(
        F.col("measure").alias("column"), "n", _mean().alias("mean"), _deviation().alias("stddev"), F.col("low").alias("min"), F.col("high").alias("max")
    )


def avg_by_key_state(state: DataFrame, key: str, measure: str, avg_as: str | None = None) -> DataFrame:
    """What ``avg_by_key`` gives for the rows behind a state. Sums combine without a look at the deviations."""
    mine = state.where(F.col("measure") == measure).groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return mine.select(key, _mean().alias(avg_as or f"avg_{measure}"))


def outlier_groups_state(state: DataFrame, key: str, measure: str, k: float = 2.0, avg_as: str | None = None) -> DataFrame:
    """What ``outlier_groups`` gives for the rows behind a state: ``(key, avg, n)``, highest first."""
    avg_as = avg_as or f"avg_{measure}"
    mine = state.where(F.col("measure") == measure)
    whole = checkpointed(merge_moments(mine).select((_mean() + F.lit(float(k)) * _deviation()).alias("edge")))
    groups = mine.groupBy(key).agg(F.sum("total").alias("total"), F.sum("n").alias("known"), F.sum("rows").alias("n"))
    shown = groups.select(key, F.try_divide("total", "known").alias(avg_as), "n")
    return shown.where(F.col(avg_as) > whole.scalar()).orderBy(F.desc(avg_as), F.asc_nulls_last(key))
