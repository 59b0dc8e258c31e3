from datetime import datetime, timedelta

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tests.trips import TEN, table, trip, values
from tripkit import operators as op

START = "tpep_pickup_datetime"


@pytest.fixture(scope="module")
def trips(spark):
    rows = [
        trip(start=TEN + timedelta(hours=i % 3), place=i % 4, fare=float(10 + i % 5), party=i % 3 or None)
        for i in range(24)
    ]
    return table(spark, *rows).cache()


def test_distribution_keeps_nulls_as_a_group(trips):
    assert values(op.distribution(trips, "passenger_count")) == [(None, 8), (1, 8), (2, 8)]
    assert sum(n for _k, n in values(op.distribution(trips, "passenger_count"))) == trips.count()


def test_ties_take_the_smaller_key(trips):
    assert values(op.topk_by_count(trips, "PULocationID", k=2)) == [(0, 6), (1, 6)]
    assert values(op.sql_topk_by_count(trips, "PULocationID", k=2)) == [(0, 6), (1, 6)]
    assert values(op.peak_hour(trips, START)) == [(10, 8)]
    assert values(op.count_by_hour(trips, START)) == [(10, 8), (11, 8), (12, 8)]


def test_topk_by_sum(spark):
    df = table(spark, trip(place=1, fare=5.0), trip(place=2, fare=9.0), trip(place=1, fare=5.0), trip(place=3, fare=None or 10.0))
    wanted = [(1, 10.0), (3, 10.0)]
    assert values(op.topk_by_sum(df, "PULocationID", "fare_amount", k=2)) == wanted
    assert values(op.sql_topk_by_sum(df, "PULocationID", "fare_amount", k=2)) == wanted


def test_hours_pool_days(spark):
    df = table(spark, trip(fare=10.0), trip(start=TEN + timedelta(days=1), fare=30.0), trip(start=TEN + timedelta(hours=5), fare=20.0))
    assert values(op.avg_by_hour(df, START, "fare_amount")) == [(10, 20.0), (15, 20.0)]
    assert values(op.peak_avg_hour(df, START, "fare_amount")) == [(10, 20.0)]
    assert values(op.sql_avg_by_hour(df, START, "fare_amount")) == [(10, 20.0), (15, 20.0)]


@pytest.mark.parametrize(
    "frame_api, sql_api",
    [
        (lambda t: op.count_by_hour(t, START), lambda t: op.sql_count_by_hour(t, START)),
        (lambda t: op.avg_by_hour(t, START, "fare_amount"), lambda t: op.sql_avg_by_hour(t, START, "fare_amount")),
        (lambda t: op.topk_by_count(t, "PULocationID"), lambda t: op.sql_topk_by_count(t, "PULocationID")),
    ],
)
def test_both_apis_agree(trips, frame_api, sql_api):
    op.assert_same(frame_api(trips), sql_api(trips))


def test_sql_avgs_by_key(trips):
    rows = values(op.sql_avgs_by_key(trips, "passenger_count", "fare_amount", "trip_distance", "a", "b"))
    assert [row[0] for row in rows] == [None, 1, 2]
    assert all(row[2] == 5.0 for row in rows)


def test_names_with_blanks_and_quotes(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "`a b` int, `m``x` double")
    assert values(op.having_avg_gt(df, "a b", "m`x", 2.0, "avg of m")) == [(1, 3.0, 2)]
    assert op.sql_topk_by_count(df, "a b").columns == ["a b", "n"]


def test_sql_claims_no_view_name(spark, trips):
    before = {t.name for t in spark.catalog.listTables()}
    op.sql_count_by_hour(trips, START).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def direct_outliers(df, key, measure, k):
    m, s = df.agg(F.avg(measure), F.stddev_samp(measure)).first()
    per_key = df.groupBy(key).agg(F.avg(measure).alias("a"), F.count("*").alias("n"))
    return values(per_key.where(F.col("a") > m + k * s).orderBy(F.desc("a"), key))


@pytest.mark.parametrize("k", [0.0, 0.5, 1.0, 2.0])
def test_outlier_groups_equal_two_passes(spark, k):
    rows = [trip(place=i % 50, fare=5.0 + i % 7 + (300.0 if i % 50 == 3 else 0)) for i in range(500)]
    rows += [trip(place=None, fare=900.0), trip(place=60, fare=float(80))]
    df = table(spark, *rows)
    df = df.withColumn("fare_amount", F.when(F.col("PULocationID") != 7, F.col("fare_amount")))
    ours = values(op.outlier_groups(df, "PULocationID", "fare_amount", k))
    wanted = direct_outliers(df, "PULocationID", "fare_amount", k)
    assert [(r[0], r[2]) for r in ours] == [(r[0], r[2]) for r in wanted]
    assert [r[1] for r in ours] == pytest.approx([r[1] for r in wanted])


def test_outlier_deviation_is_stable_far_from_zero(spark):
    df = spark.range(1000).select(
        (F.col("id") % 20).alias("k"), (F.lit(1e9) + F.col("id") % 20 * 0.5 + F.col("id") % 3).alias("v")
    )
    assert [r[0] for r in values(op.outlier_groups(df, "k", "v", 1.0))] == [
        r[0] for r in direct_outliers(df, "k", "v", 1.0)
    ]


def test_column_names_of_the_table_do_not_clash_with_ours(spark):
    names = ["n", "known", "mean", "variance", "group_key", "pickup_hour", "k"]
    df = table(spark, trip(place=1), trip(place=2, fare=30.0)).withColumns({name: F.lit(-1) for name in names})
    assert values(op.outlier_groups(df, "PULocationID", "fare_amount", 0.1)) == [(2, 30.0, 1)]
    assert values(op.sql_count_by_hour(df, START)) == values(op.count_by_hour(df, START)) == [(10, 2)]
    assert values(op.sql_avg_by_hour(df, START, "fare_amount")) == [(10, 25.0)]
    assert values(op.sql_topk_by_count(df, "PULocationID", 1)) == values(op.topk_by_count(df, "PULocationID", 1))


def test_a_nan_does_not_hide_outlier_groups(spark):
    rows = [(i % 50, 5.0 + i % 7) for i in range(500)] + [(99, 900.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    nan = spark.createDataFrame([(3, float("nan")), (98, float("nan"))], "k int, v double")
    assert [r[0] for r in values(op.outlier_groups(df, "k", "v"))] == [99]
    assert [r[0] for r in values(op.outlier_groups(df.unionAll(nan), "k", "v"))] == [99]


def test_outlier_groups_of_one_row(spark):
    assert op.outlier_groups(table(spark, trip()), "PULocationID", "fare_amount").count() == 0


def test_demand_and_weekend(spark):
    saturday = datetime(2024, 1, 13, 10, 0)
    df = table(spark, trip(), trip(), trip(start=saturday, fare=40.0), trip(place=2))
    demand = {row[:4]: row[4] for row in values(op.demand_table(df, "PULocationID", START))}
    assert demand == {(1, 10, "Wed", 0): 2, (1, 10, "Sat", 1): 1, (2, 10, "Wed", 0): 1}
    split = sorted(values(op.weekend_split(df, START, "fare_amount")))
    assert split == [(0, 3, 20.0), (1, 1, 40.0)]


def test_revenue_vs_volume(spark):
    df = table(spark, trip(place=1), trip(place=1), trip(place=2, fare=90.0), trip(place=3), trip(place=3))
    rows = sorted(values(op.revenue_vs_volume(df, "PULocationID", "fare_amount")))
    assert rows == [(1, 2, 40.0, 1, 2), (2, 1, 90.0, 3, 1), (3, 2, 40.0, 2, 3)]


def test_position_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(9)
    placed = op.with_position(df, F.asc("v"), out="at")
    assert placed.where("at < 0 or at >= 5000").count() == 0
    assert placed.select("at").distinct().count() == 5000
    in_order = [v for v, _at in sorted(values(placed), key=lambda row: row[1])]
    assert in_order == sorted(in_order)


def test_category_index_equals_the_indexer(spark):
    names = ["b", "a", "c", "a", "d", "d", None, "c"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    ours = [name for name, _i in sorted(values(op.category_index(df, "name")), key=lambda row: row[1])]
    fitted = StringIndexer(inputCol="name", outputCol="i", handleInvalid="skip").fit(df)
    assert ours == list(fitted.labels)


def test_profile(trips):
    assert values(op.row_count(trips)) == [24]
    assert op.range_stats(trips, "fare_amount", "fare").columns == ["min_fare", "max_fare", "avg_fare"]
    summary = {row["column"]: row for row in op.summarize(trips, ["fare_amount", "passenger_count"]).collect()}
    described = {r["summary"]: r["fare_amount"] for r in trips.select("fare_amount").describe().collect()}
    fare = summary["fare_amount"]
    assert (fare["n"], fare["min"], fare["max"]) == (24, 10.0, 14.0)
    assert fare["mean"] == pytest.approx(float(described["mean"]))
    assert fare["stddev"] == pytest.approx(float(described["stddev"]))
    assert summary["passenger_count"]["n"] == 16
    assert values(op.sample_rows(trips, 2, [F.desc("fare_amount")]), "fare_amount") == [14.0, 14.0]
    assert op.sample_rows(trips).count() == 5


def test_parity_counts_duplicates(spark):
    one = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    two = spark.createDataFrame([(None,), (1,), (2,), (2,)], "x int")
    assert sorted(values(op.differences(one, two))) == [(1, 1), (2, -1)]
    assert values(op.parity(one, two)) == [(4, 4, 2)]
    op.assert_same(one, one.repartition(3))
    with pytest.raises(AssertionError):
        op.assert_same(one, two)
    with pytest.raises(ValueError):
        op.differences(one, two.withColumnRenamed("x", "y"))
