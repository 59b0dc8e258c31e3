"""Where rows come from."""

from tripkit.sources.months import read_stored_months, store_months
from tripkit.sources.session import session
from tripkit.sources.tables import (
    as_view,
    read_months,
    read_table,
    read_trips,
    schema_table,
    trips_from_events,
    union_months,
)

__all__ = [
    "as_view",
    "read_months",
    "read_stored_months",
    "read_table",
    "read_trips",
    "schema_table",
    "session",
    "store_months",
    "trips_from_events",
    "union_months",
]
