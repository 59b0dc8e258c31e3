import math
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tests.trips import TEN, table, trip, values
from tripkit import operators as op
from tripkit.sources import read_stored_months, read_trips, store_months

ROWS = [("a", 1, 1e9 + 4.0, 1.0), ("a", 2, 1e9 + 7.0, None), ("a", 2, 1e9 + 13.0, 2.0), ("b", 1, 1e9 + 16.0, None), (None, 2, None, 5.0)]


def test_states_combine_to_the_state_of_all_rows(spark):
    df = spark.createDataFrame(ROWS, "k string, m int, x double, y double")
    state = op.moments(df, ["m", "k"], ["x", "y"])
    assert state.count() == 2 * 4
    found = {r["column"]: r for r in op.summarize_state(state).collect()}
    xs = [4.0, 7.0, 13.0, 16.0]
    assert found["x"]["n"] == 4 and found["x"]["mean"] == 1e9 + 10
    assert found["x"]["stddev"] == pytest.approx(statistics.stdev(xs), rel=1e-9)  # no cancellation at 1e9
    assert (found["x"]["min"], found["x"]["max"]) == (1e9 + 4, 1e9 + 16)
    assert (found["y"]["n"], found["y"]["mean"]) == (3, 8 / 3)
    assert sorted(values(op.avg_by_key_state(state, "k", "x")), key=str) == sorted(values(op.avg_by_key(df, "k", "x")), key=str)
    merged = {r["k"]: r for r in op.merge_moments(state, ["k"]).where("measure = 'x'").collect()}
    assert merged["a"]["rows"] == 3 and merged["a"]["m2"] == pytest.approx(42.0) and merged[None]["n"] == 0


def test_few_rows(spark):
    df = spark.createDataFrame(ROWS[:1], "k string, m int, x double, y double")
    one = op.summarize_state(op.moments(df, ["k"], ["x"])).first()
    assert one["n"] == 1 and one["stddev"] is None
    assert op.summarize_state(op.moments(df.limit(0), ["k"], ["x"])).count() == 0
    assert op.outlier_groups_state(op.moments(df.limit(0), ["k"], ["x"]), "k", "x").count() == 0


def test_outliers_equal_the_full_scan(spark):
    i = F.col("id")
    df = spark.range(4000).select((i % 40).alias("k"), (i % 3).alias("m"), (F.when(i % 40 == 7, 50.0).otherwise(1.0) + i % 10).alias("x"))
    state = op.moments(df, ["m", "k"], ["x"])
    assert values(op.outlier_groups_state(state, "k", "x")) == values(op.outlier_groups(df, "k", "x")) != []


def three_months(spark):
    return [table(spark, *[trip(start=TEN.replace(month=m, day=d), fare=10.0 * m) for d in range(1, 11)]) for m in (1, 2, 3)]


def files(spark, path):
    return {r[0] for r in read_trips(spark, path).select(F.input_file_name()).distinct().collect()}


def test_a_month_is_renewed_alone_and_read_alone(spark, tmp_path):
    path = str(tmp_path / "trips")
    january, february, march = three_months(spark)
    store_months(january.unionAll(february), path)
    kept = {f for f in files(spark, path) if "month=2024-01" in f}
    store_months(march, path)
    store_months(february.limit(3), path)
    assert kept == {f for f in files(spark, path) if "month=2024-01" in f}
    assert sorted(values(op.distribution(read_stored_months(spark, path), "month"))) == [("2024-01", 10), ("2024-02", 3), ("2024-03", 10)]
    one = read_stored_months(spark, path, "2024-02", "2024-02")
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "2024-02" in filters and "PushedFilters: []" in plan
    assert {f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]} <= {f for f in files(spark, path) if "month=2024-02" in f}
    assert one.count() == 3
    with pytest.raises(ValueError):
        store_months(read_stored_months(spark, path), str(tmp_path / "again"))


def test_rows_without_a_month_and_hot_months(spark, tmp_path):
    path = str(tmp_path / "trips")
    january = three_months(spark)[0]
    store_months(january.unionAll(table(spark, trip(start=None, end=TEN))).repartition(40), path)
    assert read_stored_months(spark, path).where("month IS NULL").count() == 1
    assert read_stored_months(spark, path, "2024-01").count() == 10
    assert len(files(spark, path)) == 2  # not one for each of 40 tasks


def test_a_stored_state_answers_without_the_trips(spark, tmp_path):
    path, months = str(tmp_path / "state"), three_months(spark)
    for month in months:
        store_months(op.month_moments(month, "tpep_pickup_datetime", "PULocationID", ["fare_amount", "trip_distance"]), path)
    state, whole = read_stored_months(spark, path), months[0].unionAll(months[1]).unionAll(months[2])
    got = {r["column"]: r for r in op.summarize_state(state).collect()}
    for r in op.summarize(whole, ["fare_amount", "trip_distance"]).collect():
        assert all(math.isclose(got[r["column"]][c], r[c], abs_tol=1e-12) for c in ("n", "mean", "stddev", "min", "max"))
    with pytest.raises(AnalysisException):
        state.select("tpep_pickup_datetime")
