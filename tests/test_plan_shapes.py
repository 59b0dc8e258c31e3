"""The plans are the ones wanted: what is read, what is pushed down, what is shuffled."""

import re

import pytest

from tests.trips import table, trip
from tripkit import operators as op
from tripkit.plans import queries
from tripkit.sources import read_table, read_trips, union_months

FOLDER = "/root/testdata/sf0.001"
START = "tpep_pickup_datetime"


def executed(df):
    """The final adaptive plan with its subqueries, without the initial plans they started from."""
    df.collect()
    kept, skip_below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :"))
        if skip_below is not None and depth > skip_below:
            continue
        skip_below = depth if "== Initial Plan ==" in line else None
        kept.append(line)
    return "\n".join(kept)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def read_columns(plan):
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]


@pytest.fixture(scope="module")
def trips(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "trips")
    table(spark, *[trip(place=i % 9, fare=float(i)) for i in range(50)]).write.parquet(path)
    return read_trips(spark, path)


def test_cleaning_bounds_reach_the_scan(trips):
    plan = planned(op.clean(trips, op.trip_rules()))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    for bound in (
        "GreaterThan(trip_distance,0.0)",
        "LessThanOrEqual(trip_distance,100.0)",
        "GreaterThan(fare_amount,0.0)",
        "LessThanOrEqual(fare_amount,500.0)",
        "GreaterThan(passenger_count,0)",
        "LessThanOrEqual(passenger_count,6)",
    ):
        assert bound in pushed


@pytest.mark.parametrize(
    "query, columns",
    [
        (lambda t: op.avg_by_key(t, "PULocationID", "fare_amount"), {"PULocationID", "fare_amount"}),
        (lambda t: op.topk_by_count(t, "PULocationID"), {"PULocationID"}),
        (lambda t: op.sql_topk_by_count(t, "PULocationID"), {"PULocationID"}),
        (lambda t: op.count_by_hour(t, START), {START}),
        (lambda t: op.summarize(t, ["tip_amount"]), {"tip_amount"}),
        (lambda t: op.avg_by_key(op.relayout(t, 3), "PULocationID", "fare_amount"), {"PULocationID", "fare_amount"}),
        (lambda t: op.row_count(union_months([t, t])), set()),
        (
            lambda t: op.quality_report(t, op.trip_rules()),
            {"trip_distance", "fare_amount", "passenger_count", START, "tpep_dropoff_datetime"},
        ),
    ],
)
def test_only_needed_columns_are_read(trips, query, columns):
    found = read_columns(planned(query(trips)))
    assert found and all(read == columns for read in found)


@pytest.mark.parametrize(
    "report", [lambda t: op.quality_report(t, op.trip_rules()), lambda t: op.removal_report(t, op.trip_rules())]
)
def test_reports_take_one_pass(trips, report):
    plan = executed(report(trips))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange SinglePartition") == 1


def test_outlier_groups_compare_groups_only(trips):
    result = op.outlier_groups(trips, "PULocationID", "fare_amount", k=0.0)
    plan = executed(result)
    assert "FileScan" not in plan
    assert result.count() > 0


@pytest.mark.parametrize("name", ["topk_by_count", "topk_by_sum", "sql_topk_by_count", "peak_hour", "peak_avg_hour", "sample_rows"])
def test_top_rows_need_no_full_sort(spark, name):
    plan = executed(queries()[name](spark, FOLDER))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_relayout_by_key_shuffles_the_needed_columns(spark):
    plan = planned(queries()["relayout_by_key_avg"](spark, FOLDER))
    assert read_columns(plan) == [{"l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber"}]


def test_months_stored_in_folders_are_pruned(spark, tmp_path):
    for month in ("2024-01", "2024-02"):
        table(spark, trip()).write.parquet(str(tmp_path / f"month={month}"))
    one = read_trips(spark, str(tmp_path)).where("month = '2024-02'")
    assert re.search(r"PartitionFilters: \[[^\]]*month", planned(one))
    assert one.count() == 1


def test_month_bound_reaches_the_scan(spark):
    plan = planned(queries()["union_months"](spark, FOLDER))
    assert "LessThan(ts," in plan and "GreaterThanOrEqual(ts," in plan


LAZY = sorted(
    set(queries()) - {"forest_scores", "gbt_scores", "feature_importances", "compare_models", "demand_forest"}
)


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_cross_join(spark, name):
    plan = planned(queries()[name](spark, FOLDER))
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("avg_by_key", "demand_table", "topk_by_sum", "having_avg_gt", "distribution"):
        assert "partial_" in planned(queries()[name](spark, FOLDER))


def test_features_stay_in_one_stage(spark):
    plan = executed(queries()["features"](spark, FOLDER))
    assert "Exchange" not in plan
    assert len(read_columns(plan)) == 1


def test_scan_of_a_wide_table_for_a_count(spark):
    assert read_columns(planned(op.row_count(read_table(spark, FOLDER, "lineitem")))) == [set()]


def test_json_is_parsed_once_and_late(spark):
    plan = planned(queries()["features"](spark, FOLDER))
    assert plan.count("json_tuple") == 1
    # The filter on the other columns runs below the parse.
    assert re.search(r"json_tuple[\s\S]*Filter[\s\S]*FileScan", plan)


def test_json_stays_unread_where_no_distance_is_needed(spark):
    plan = planned(queries()["distribution"](spark, FOLDER))
    assert read_columns(plan) == [{"event_id"}]


def test_the_profile_is_one_pass(trips):
    plan = executed(op.profile(trips, ["fare_amount", "trip_distance"], op.trip_rules()))
    assert plan.count("FileScan") == 1 and len(re.findall(r"\bExchange\b", plan)) == 1


def test_residuals_are_computed_once(trips):
    scored = trips.selectExpr("fare_amount", "trip_distance AS prediction")
    assert "FileScan" not in executed(op.residual_anomalies(scored, "fare_amount", k=1.0))


def test_parity_ignores_the_order(trips):
    plan = executed(op.parity(op.count_by_hour(trips, START), op.sql_count_by_hour(trips, START)))
    assert "rangepartitioning" not in plan
