from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.trips import TEN, table, trip, values
from tripkit import Roles
from tripkit import operators as op

KEPT, DROPPED = True, False


@pytest.mark.parametrize(
    "row, outcome",
    [
        (trip(), KEPT),
        (trip(distance=0.0), DROPPED),
        (trip(distance=0.01), KEPT),
        (trip(distance=100.0), KEPT),
        (trip(distance=100.01), DROPPED),
        (trip(fare=-1.0), DROPPED),
        (trip(fare=0.0), DROPPED),
        (trip(fare=500.0), KEPT),
        (trip(fare=500.01), DROPPED),
        (trip(party=None), DROPPED),
        (trip(party=0), DROPPED),
        (trip(party=6), KEPT),
        (trip(party=7), DROPPED),
        (trip(minutes=0), DROPPED),
        (trip(minutes=-1), DROPPED),
        (trip(end=TEN + timedelta(microseconds=1)), KEPT),
        (trip(distance=float("nan")), DROPPED),
    ],
)
def test_clean_bounds(spark, row, outcome):
    df = table(spark, row)
    assert (op.clean(df, op.trip_rules()).count() == 1) is outcome


def test_report_reconciles_with_cleaning(spark):
    df = table(
        spark,
        trip(),
        trip(distance=0.0, fare=0.0),  # two rules, counted first under distance
        trip(fare=501.0, party=9),
        trip(party=None),
        trip(party=None, fare=-3.0),  # broken by fare, so not "null only"
        trip(minutes=-5),
    )
    rules = op.trip_rules()
    report = {rule: (n, first) for rule, n, first in values(op.quality_report(df, rules))}
    assert report == {
        "zero_or_negative_distance": (1, 1),
        "zero_or_negative_fare": (2, 1),
        "invalid_passenger_count": (1, 1),
        "extremely_long_distance": (0, 0),
        "extremely_large_fare": (1, 0),
        "invalid_timestamps": (1, 1),
        "null_only": (1, 1),
    }
    removal = op.removal_report(df, rules).first()
    assert tuple(removal)[:3] == (6, 1, 5)
    assert removal["pct"] == pytest.approx(500 / 6)
    assert sum(first for _n, first in report.values()) == removal["removed"]


def test_reports_on_no_rows(spark):
    empty = table(spark)
    rules = op.trip_rules()
    assert values(op.quality_report(empty, rules), "n", "n_first") == [(0, 0)] * 7
    assert values(op.removal_report(empty, rules)) == [(0, 0, 0, None)]
    assert values(op.summarize(empty, ["fare_amount"])) == [("fare_amount", 0, None, None, None, None)]
    assert values(op.row_count(empty)) == [0]
    assert values(op.mean_std(empty, "fare_amount")) == [(None, None)]
    assert op.outlier_groups(empty, "PULocationID", "fare_amount").count() == 0
    assert op.revenue_vs_volume(empty, "PULocationID", "fare_amount").count() == 0
    assert values(op.regression_metrics(empty, "fare_amount", "tip_amount")) == [(0, None, None, None)]


def test_own_rules_and_roles(spark):
    df = spark.createDataFrame([(1.0, 3), (9.0, 3), (1.0, 40)], "km double, seats int")
    rules = [op.Rule("far", F.col("km") > 5), op.Rule("full", F.col("seats") > 30)]
    assert values(op.quality_report(df, rules)) == [("far", 1, 1), ("full", 1, 1), ("null_only", 0, 0)]
    assert values(op.clean(df, rules)) == [(1.0, 3)]
    renamed = table(spark, trip(), trip(fare=0.0)).withColumnRenamed("fare_amount", "price")
    assert op.clean(renamed, op.trip_rules(Roles(amount="price"))).count() == 1


def test_planted_counts(spark):
    from tripkit.plans import register

    trips = register.trips(spark, "/root/testdata/sf0.01")
    report = values(op.quality_report(trips, op.trip_rules()), "n", "n_first")
    assert [n for n, _first in report] == [93, 271, 2380, 118, 73, 234, 445]
    assert [first for _n, first in report] == [93, 266, 2293, 91, 53, 171, 445]
    assert tuple(op.removal_report(trips, op.trip_rules()).first())[:3] == (10_000, 6_588, 3_412)
    assert register.featured_trips(spark, "/root/testdata/sf0.01").count() == 6_125


def test_duration_filter(spark):
    timed = op.with_duration(
        table(
            spark,
            trip(minutes=0.01),
            trip(minutes=239 + 59 / 60),
            trip(minutes=240),
            trip(minutes=1),
            trip(start=datetime(2024, 1, 10, 10, 0, 0, 100_000), end=datetime(2024, 1, 10, 10, 0, 0, 900_000)),
        ),
        "tpep_pickup_datetime",
        "tpep_dropoff_datetime",
    )
    kept = values(op.filter_duration(timed), "trip_duration_min")
    assert sorted(kept) == [1.0, pytest.approx(239.98333)]


def test_drop_nulls(spark):
    df = table(spark, trip(), trip(party=None), trip(fare=float("nan")))
    assert op.drop_nulls(df, ["passenger_count"]).count() == 2
    assert op.drop_nulls(df).count() == 1
