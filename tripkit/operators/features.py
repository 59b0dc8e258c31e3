"""Derived columns of a trip. Each operator adds one; ``with_features`` adds all in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripkit.functions import day_name, hour_of_day, minutes_between, ratio, speed, weekend_flag
from tripkit.roles import Roles

# The derived columns.
FEATURES = (
    "trip_duration_min",
    "pickup_hour",
    "day_of_week",
    "is_weekend",
    "fare_per_mile",
    "avg_speed_mph",
)


def with_duration(df: DataFrame, start: str, end: str, out: str = "trip_duration_min") -> DataFrame:
    return df.withColumn(out, minutes_between(start, end))


def with_hour(df: DataFrame, ts: str, out: str = "pickup_hour") -> DataFrame:
    return df.withColumn(out, hour_of_day(ts))


def with_day_name(df: DataFrame, ts: str, out: str = "day_of_week") -> DataFrame:
    return df.withColumn(out, day_name(ts))


def with_weekend(df: DataFrame, ts: str, out: str = "is_weekend") -> DataFrame:
    return df.withColumn(out, weekend_flag(ts))


def with_ratio(df: DataFrame, num: str, den: str, out: str = "fare_per_mile") -> DataFrame:
    return df.withColumn(out, ratio(num, den))


def with_speed(df: DataFrame, dist: str, minutes: str, out: str = "avg_speed_mph") -> DataFrame:
    return df.withColumn(out, speed(dist, minutes))


def with_features(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """All six derived columns at once."""
    minutes = minutes_between(roles.start, roles.end)
    return df.withColumns(
        dict(
            zip(
                FEATURES,
                (
                    minutes,
                    hour_of_day(roles.start),
                    day_name(roles.start),
                    weekend_flag(roles.start),
                    ratio(roles.amount, roles.distance),
                    speed(roles.distance, minutes),
                ),
            )
        )
    )
