from datetime import datetime

import pytest

from tests.trips import table, trip, values
from tripkit import functions as fn
from tripkit import operators as op
from tripkit.plans import register

START, END = "tpep_pickup_datetime", "tpep_dropoff_datetime"


def test_ordinary_trip(spark):
    row = op.with_features(table(spark, trip())).first()
    assert [row[name] for name in op.FEATURES] == [30.0, 10, "Wed", 0, 4.0, 10.0]


def test_types(spark):
    kinds = dict(op.with_features(table(spark, trip())).dtypes)
    assert [kinds[name] for name in op.FEATURES] == ["double", "int", "string", "int", "double", "double"]


def test_one_at_a_time_equals_all_at_once(spark):
    df = table(spark, trip(), trip(distance=0.0), trip(minutes=0), trip(start=datetime(2024, 1, 14, 23, 59)))
    steps = op.with_duration(df, START, END)
    steps = op.with_hour(steps, START)
    steps = op.with_day_name(steps, START)
    steps = op.with_weekend(steps, START)
    steps = op.with_ratio(steps, "fare_amount", "trip_distance")
    steps = op.with_speed(steps, "trip_distance", "trip_duration_min")
    op.assert_same(steps, op.with_features(df))


@pytest.mark.parametrize(
    "start, end, minutes",
    [
        # Each side is cut to whole seconds before the difference.
        (datetime(2024, 1, 1, 10, 0, 0, 100_000), datetime(2024, 1, 1, 10, 0, 0, 900_000), 0.0),
        (datetime(2024, 1, 1, 10, 0, 0, 900_000), datetime(2024, 1, 1, 10, 0, 1, 100_000), 1 / 60),
        (datetime(2024, 1, 1, 23, 50), datetime(2024, 1, 2, 0, 10), 20.0),
    ],
)
def test_duration_in_whole_seconds(spark, start, end, minutes):
    df = op.with_duration(table(spark, trip(start=start, end=end)), START, END)
    assert values(df, "trip_duration_min") == [minutes]


def test_duration_is_wall_clock_in_any_session_zone(spark):
    # The night New York clocks go forward.
    night = trip(start=datetime(2024, 3, 10, 1, 30), end=datetime(2024, 3, 10, 3, 30))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = op.with_features(table(spark, night)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert (row["trip_duration_min"], row["pickup_hour"], row["day_of_week"]) == (120.0, 1, "Sun")


@pytest.mark.parametrize(
    "start, name, flag",
    [
        (datetime(2024, 1, 12, 23, 59), "Fri", 0),
        (datetime(2024, 1, 13, 0, 0), "Sat", 1),
        (datetime(2024, 1, 14, 12, 0), "Sun", 1),
        (datetime(2024, 1, 15, 0, 0), "Mon", 0),
    ],
)
def test_weekend(spark, start, name, flag):
    row = op.with_features(table(spark, trip(start=start))).first()
    assert (row["day_of_week"], row["is_weekend"]) == (name, flag)


def test_zero_divisors_give_null(spark):
    df = op.with_features(table(spark, trip(distance=0.0), trip(minutes=0), trip(minutes=-3)))
    assert values(df, "fare_per_mile", "avg_speed_mph") == [(None, 0.0), (4.0, None), (4.0, None)]


def test_hash_share_depends_on_id_and_seed_only(spark):
    ids = spark.range(5000)

    def chosen(df, **kw):
        return sorted(values(df.where(fn.hash_share("id", **kw)), "id"))

    assert chosen(ids, pct=30) == chosen(ids.repartition(7), pct=30) != chosen(ids, pct=30, seed=7)
    assert set(chosen(ids, pct=30)) < set(chosen(ids, pct=60))
    for pct in (0, 1, 30, 50, 99, 100):
        assert len(chosen(ids, pct=pct)) == pytest.approx(50 * pct, abs=130 if 0 < pct < 100 else 0)


def test_hash_share_at_its_ends_and_with_null_ids(spark):
    ids = spark.range(20_000)
    assert ids.where(fn.hash_share("id", pct=99.99999999)).count() == 20_000
    assert ids.where(fn.hash_share("id", pct=0)).count() == 0
    pairs = spark.createDataFrame([(None, str(i)) for i in range(200)], "a string, b string")
    swapped = pairs.select(pairs.b.alias("a"), pairs.a.alias("b"))
    chosen, other = (set(values(d.where(fn.hash_share("a", "b", pct=50)), c)) for d, c in ((pairs, "b"), (swapped, "a")))
    assert chosen != other


def test_preview(spark):
    df = register.featured_trips(spark, "/root/testdata/sf0.001")
    assert df.select("trip_distance", "fare_amount", *op.FEATURES).limit(5).count() == 5
