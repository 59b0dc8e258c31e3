"""Hand-written trips for the unit tests."""

from datetime import datetime, timedelta

SCHEMA = (
    "tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count bigint, "
    "trip_distance double, fare_amount double, tip_amount double, total_amount double, PULocationID int"
)
TEN = datetime(2024, 1, 10, 10, 0)  # a Wednesday


def trip(start=TEN, minutes=30.0, party=1, distance=5.0, fare=20.0, place=1, end=None):
    end = end if end is not None else start + timedelta(minutes=minutes)
    return (start, end, party, distance, fare, 2.0, fare + 2.0, place)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def values(df, *columns):
    """Rows as tuples, or plain values for one column."""
    rows = df.select(*columns).collect() if columns else df.collect()
    return [row[0] if len(row) == 1 else tuple(row) for row in rows]
