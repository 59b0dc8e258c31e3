"""Column roles: which column of a table plays which part of a trip."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Binds the operators to column names.

    The defaults are the column names of the public yellow-taxi trip files; bind other
    names to run the same operators on any table with a start, an end, a place and amounts.
    """

    start: str = "tpep_pickup_datetime"
    end: str = "tpep_dropoff_datetime"
    place: str = "PULocationID"
    party: str = "passenger_count"
    distance: str = "trip_distance"
    amount: str = "fare_amount"
