"""Properties that hold for any rows."""

from datetime import timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.trips import TEN, table, trip, values
from tripkit import operators as op

trips = st.builds(
    trip,
    start=st.integers(0, 60 * 24 * 20).map(lambda m: TEN + timedelta(minutes=m)),
    minutes=st.sampled_from([-5, 0, 0.5, 30, 239.9, 240, 600]),
    party=st.sampled_from([None, -1, 0, 1, 6, 7]),
    distance=st.sampled_from([-1.0, 0.0, 0.01, 5.0, 100.0, 100.01]),
    fare=st.sampled_from([-1.0, 0.0, 7.5, 500.0, 500.01]),
    place=st.sampled_from([None, 1, 2, 3]),
)
some_trips = st.lists(trips, max_size=25)
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@few
@given(rows=some_trips)
def test_cleaning_adds_up(spark, rows):
    df = table(spark, *rows)
    rules = op.trip_rules()
    kept = op.clean(df, rules)
    before, after, removed, pct = op.removal_report(df, rules).first()
    firsts = values(op.quality_report(df, rules), "n_first")
    assert (before, after) == (len(rows), kept.count())
    assert removed == before - after == sum(firsts)
    assert (pct is None) == (not rows)
    assert values(op.removal_report(kept, rules), "removed") == [0]


@few
@given(rows=some_trips)
def test_counts_add_up(spark, rows):
    df = table(spark, *rows)
    for report in (
        op.distribution(df, "passenger_count"),
        op.count_by_hour(df, "tpep_pickup_datetime"),
        op.demand_table(df, "PULocationID", "tpep_pickup_datetime"),
        op.weekend_split(df, "tpep_pickup_datetime", "fare_amount"),
        op.topk_by_count(df, "PULocationID", k=100),
    ):
        assert sum(values(report, "n")) == len(rows)


@few
@given(rows=some_trips)
def test_ranks_are_a_permutation(spark, rows):
    ranked = op.revenue_vs_volume(table(spark, *rows), "PULocationID", "fare_amount").collect()
    places = list(range(1, len({row[-1] for row in rows}) + 1))
    assert sorted(r["volume_rank"] for r in ranked) == places
    assert sorted(r["revenue_rank"] for r in ranked) == places
    by_volume = sorted(ranked, key=lambda r: r["volume_rank"])
    assert [r["n"] for r in by_volume] == sorted((r["n"] for r in ranked), reverse=True)
