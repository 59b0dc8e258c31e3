"""Column expressions."""

from tripkit.functions.columns import (
    as_column,
    day_name,
    hash_share,
    hash_text,
    hour_of_day,
    minutes_between,
    ratio,
    speed,
    weekend_flag,
)
from tripkit.functions.names import free_name

__all__ = [
    "as_column",
    "day_name",
    "free_name",
    "hash_share",
    "hash_text",
    "hour_of_day",
    "minutes_between",
    "ratio",
    "speed",
    "weekend_flag",
]
