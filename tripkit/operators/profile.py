"""Profiling: one pass over the columns asked for, nothing else is read."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripkit.operators.quality import Rule


def row_count(df: DataFrame) -> DataFrame:
    """``n``: number of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def sample_rows(df: DataFrame, n: int = 5, order_by: Sequence[Column | str] = ()) -> DataFrame:
    """The first ``n`` rows; pass ``order_by`` to get the same ones every time."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def summarize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, mean, stddev, min, max)`` with one row per numeric column.

    All columns are measured in one aggregation; its single row is then turned into rows.
    """
    measures = {
        "n": F.count,
        "mean": F.avg,
        "stddev": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    wide = df.agg(
        *[
            F.struct(F.lit(name).alias("column"), *[f(F.col(name)).alias(out) for out, f in measures.items()]).alias(
                f"summary_{position}"
            )
            for position, name in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def range_stats(df: DataFrame, column: str, suffix: str | None = None) -> DataFrame:
    """``(min_x, max_x, avg_x)`` of one column, named after ``suffix`` or the column."""
    suffix = suffix or column
    return df.agg(
        F.min(column).alias(f"min_{suffix}"),
        F.max(column).alias(f"max_{suffix}"),
        F.avg(column).alias(f"avg_{suffix}"),
    )


def mean_std(df: DataFrame, column: str) -> DataFrame:
    """``(mean, stddev)``; the sample deviation is NULL below two rows."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("stddev"))


def profile(df: DataFrame, measures: Sequence[str], rules: Sequence[Rule] = ()) -> DataFrame:
    """Rows, measures and rules in one pass: ``(section, name, n, mean, stddev, min, max)``.

    Section ``table`` has the number of rows and of rows that ``rules`` keep (``rows``, ``kept``),
    ``measure`` a line per numeric column as ``summarize`` has it, ``rule`` the rows that
    break each rule. What a section doesn't have is NULL. One scan and one shuffle of one row
    per task, where separate reports read the table once each.
    """
    nothing = F.lit(None).cast("double")

    def line(section: str, name: str, n: Column, *stats: Column) -> Column:
        mean, deviation, low, high = stats or (nothing,) * 4
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("name"),
            n.alias("n"),
            mean.cast("double").alias("mean"),
            deviation.cast("double").alias("stddev"),
            low.cast("double").alias("min"),
            high.cast("double").alias("max"),
        )

    good = reduce(and_, [~rule.bad for rule in rules], F.lit(True))
    lines = [line("table", "rows", F.count(F.lit(1))), line("table", "kept", F.count_if(good))]
    for name in measures:
        c = F.col(name)
        lines.append(line("measure", name, F.count(c), F.avg(c), F.stddev_samp(c), F.min(c), F.max(c)))
    lines += [line("rule", rule.name, F.count_if(rule.bad)) for rule in rules]
    wide = df.agg(*[entry.alias(f"line_{i}") for i, entry in enumerate(lines)])
    return wide.select(F.inline(F.array(*wide.columns)))
