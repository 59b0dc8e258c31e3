"""Data quality: named rules, a one-pass report, cleaning and NULL removal."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripkit.roles import Roles

# The bounds of a believable trip. The lower bounds of distance and amount are
# strict, the upper ones and both ends of the party size and minutes are as commented.
MAX_DISTANCE = 100  # allowed
MAX_AMOUNT = 500  # allowed
MAX_PARTY = 6  # allowed; the smallest party is above 0
MIN_MINUTES = 0  # not allowed
MAX_MINUTES = 240  # not allowed


@dataclass(frozen=True)
class Rule:
    """A named condition that holds for bad rows. Where it is NULL, the row is neither good nor bad."""

    name: str
    bad: Column


def trip_rules(
    roles: Roles = Roles(),
    max_distance: float = MAX_DISTANCE,
    max_amount: float = MAX_AMOUNT,
    max_party: int = MAX_PARTY,
) -> list[Rule]:
    """The six rules for trips; add your own to the list or leave some out."""
    distance, amount, party = F.col(roles.distance), F.col(roles.amount), F.col(roles.party)
    # The names of the rules, and their order, which decides what comes first.
    return [
        Rule("zero_or_negative_distance", distance <= 0),
        Rule("zero_or_negative_fare", amount <= 0),
        Rule("invalid_passenger_count", (party <= 0) | (party > max_party)),
        Rule("extremely_long_distance", distance > max_distance),
        Rule("extremely_large_fare", amount > max_amount),
        Rule("invalid_timestamps", F.col(roles.end) <= F.col(roles.start)),
    ]


def _good(rules: Sequence[Rule]) -> Column:
    # The optimizer turns each negated comparison into a plain one, which Parquet can use.
    return reduce(and_, [~rule.bad for rule in rules])


def quality_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(rule, n, n_first)``: rows that break a rule, and rows for which it is the first one broken.

    A last row, ``null_only``, counts rows that break no rule but have one that is NULL, so
    that the ``n_first`` add up to the rows that ``clean`` removes. One pass over the table.
    """
    places = range(len(rules))
    judged = df.select(
        *[rule.bad.alias(f"bad_{i}") for i, rule in enumerate(rules)],
        F.coalesce(*[F.when(rule.bad, i) for i, rule in enumerate(rules)]).alias("first"),
    )
    undecided = F.col("first").isNull() & reduce(
        lambda a, b: a | b, [F.col(f"bad_{i}").isNull() for i in places]
    )
    counts = judged.agg(
        *[F.count_if(f"bad_{i}").alias(f"n_{i}") for i in places],
        *[F.count_if(F.col("first") == i).alias(f"first_{i}") for i in places],
        F.count_if(undecided).alias("undecided"),
    )

    def line(name: str, n: str, n_first: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.col(n).alias("n"), F.col(n_first).alias("n_first"))

    lines = [line(rule.name, f"n_{i}", f"first_{i}") for i, rule in enumerate(rules)]
    return counts.select(F.inline(F.array(*lines, line("null_only", "undecided", "undecided"))))


def clean(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Keep the rows that surely break no rule; a NULL in a rule drops the row."""
    return df.where(_good(rules))


def removal_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(before, after, removed, pct)`` in one pass; ``pct`` is in percent, NULL for no rows."""
    counts = df.agg(F.count(F.lit(1)).alias("before"), F.count_if(_good(rules)).alias("after"))
    removed = F.col("before") - F.col("after")
    return counts.select(
        "before",
        "after",
        removed.alias("removed"),
        F.try_divide(removed * F.lit(100.0), F.col("before")).alias("pct"),
    )


def filter_duration(
    df: DataFrame, lo: float = MIN_MINUTES, hi: float = MAX_MINUTES, minutes: str = "trip_duration_min"
) -> DataFrame:
    """Keep trips that last longer than ``lo`` and less than ``hi`` minutes."""
    return df.where((F.col(minutes) > lo) & (F.col(minutes) < hi))


def drop_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in any of the columns (default: all)."""
    return df.na.drop(how="any", subset=list(columns) if columns is not None else None)
