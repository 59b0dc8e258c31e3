"""Column expressions for trips. All are built-in, row-local and NULL-safe."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day numbers of Sunday and Saturday in Spark's dayofweek.
WEEKEND_DAYS = (1, 7)
# Units.
SECONDS_PER_MINUTE = 60.0
MINUTES_PER_HOUR = 60.0
# What stands for a NULL id in the text of ids.
NULL_ID = "\\N"


def as_column(value: Column | str) -> Column:
    """A column name or a column, as a column."""
    return F.col(value) if isinstance(value, str) else value


def hour_of_day(ts: Column | str) -> Column:
    """Hour 0..23, whatever the day."""
    return F.hour(as_column(ts))


def day_name(ts: Column | str) -> Column:
    """``Mon`` .. ``Sun``."""
    return F.dayname(as_column(ts))


def weekend_flag(ts: Column | str) -> Column:
    """1 on Saturday and Sunday, otherwise 0 (0 also for a NULL timestamp)."""
    return F.when(F.dayofweek(as_column(ts)).isin(*WEEKEND_DAYS), 1).otherwise(0)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minutes from ``start`` to ``end``; each side is cut to whole seconds first."""
    seconds = F.unix_timestamp(as_column(end)) - F.unix_timestamp(as_column(start))
    return seconds / SECONDS_PER_MINUTE


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient, NULL where the denominator is zero."""
    return F.try_divide(as_column(numerator), as_column(denominator))


def speed(distance: Column | str, minutes: Column | str) -> Column:
    """Distance per hour, NULL unless the trip took time."""
    minutes = as_column(minutes)
    return F.when(minutes > 0, F.try_divide(as_column(distance), minutes / MINUTES_PER_HOUR))


def hash_share(*ids: Column | str, pct: float, seed: int = 42) -> Column:
    """True for about ``pct`` percent of the ids.

    Depends on the ids and the seed only, so it stays the same whatever the partitioning, the
    retry or the engine, unlike a random draw. Digests are compared as text with the share of
    their range, which spares turning each into a number.
    """
    edge = math.ceil(pct / 100 * 2**32)
    if edge >= 2**32:
        return F.lit(True)
    return hash_text(*ids, seed=seed) < f"{edge:08x}"


def hash_text(*ids: Column | str, seed: int = 42) -> Column:
    """32 hexadecimal digits that depend on the ids and the seed only."""
    # A NULL id is a value of its own: the text of ids must tell (NULL, a) from (a, NULL).
    parts = [F.coalesce(as_column(i).cast("string"), F.lit(NULL_ID)) for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
