from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.trips import values
from tripkit import operators as op


def stamps(spark, rows):
    return spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))


def test_panel_has_every_hour_of_every_day_of_every_key(spark):
    rows = [("a", "2024-01-30 05:10:00"), ("a", "2024-01-30 05:50:00"), (None, "2024-02-02 23:59:59"), ("a", None), ("c", None)]
    cells = op.demand_panel(stamps(spark, rows), "k", "t")
    assert cells.columns == ["k", "date", "pickup_hour", "day_of_week", "is_weekend", "n"]
    assert cells.count() == 2 * 4 * 24 == cells.select("k", "date", "pickup_hour").distinct().count()
    assert sorted(values(cells.where("n > 0"), "k", "date", "pickup_hour", "day_of_week", "is_weekend", "n"), key=str) == [
        ("a", date(2024, 1, 30), 5, "Tue", 0, 2),
        (None, date(2024, 2, 2), 23, "Fri", 0, 1),
    ]
    assert op.demand_panel(stamps(spark, [("a", None)]), "k", "t").count() == 0


def test_clashing_names(spark):
    df = stamps(spark, [("a", "2024-01-30 05:10:00")]).withColumnRenamed("k", "their_key").withColumn("date", F.lit(1)).withColumn("n", F.lit(5))
    assert values(op.demand_panel(df, "their_key", "t").where("n > 0"), "n") == [1]


def test_days_are_held_out_whole(spark):
    rows = [("a", f"2024-01-{d:02d} 01:00:00") for d in (1, 4, 10)]
    panel = op.demand_panel(stamps(spark, rows), "k", "t")
    earlier, later = op.time_split(panel, 80)
    assert values(earlier.agg(F.max("date"))) == [date(2024, 1, 8)] and values(later.agg(F.min("date"))) == [date(2024, 1, 9)]
    assert earlier.count() + later.count() == panel.count()
    one, none = op.time_split(op.demand_panel(stamps(spark, rows[:1]), "k", "t"))
    assert one.count() == 24 and none.count() == 0
    assert [part.count() for part in op.time_split(panel.limit(0))] == [0, 0]


def test_cell_means(spark):
    train = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), (None, 1, 7.0)], "k string, h int, y double")
    cells = spark.createDataFrame([("a", 1), (None, 1), ("b", 1)], "k string, h int")
    assert sorted(values(op.cell_means(train, cells, ["k", "h"], "y", "mean")), key=str) == [("a", 1, 3.0), ("b", 1, None), (None, 1, 7.0)]


def test_a_key_with_ten_thousand_values(spark):
    # Every tenth place has a trip each hour, the others one in all.
    i = F.col("id")
    busy = spark.range(1000 * 24 * 4).select(
        F.concat(F.lit("place "), i % 1000 * 10).alias("PULocationID"), F.floor(i / 1000).cast("int").alias("at")
    )
    quiet = spark.range(10_000).select(F.concat(F.lit("place "), i).alias("PULocationID"), (i % 96).cast("int").alias("at"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    trips = busy.unionAll(quiet).select("PULocationID", (start + F.make_dt_interval(F.lit(0), "at")).alias("tpep_pickup_datetime"))
    model, scored = op.fit_demand(trips, spec=op.ForestSpec(trees=3, depth=3), pct=75)
    assert model.codes.table.count() == 10_000
    by_place = scored.groupBy((F.col("trip_count") > 0).alias("busy")).agg(F.avg("prediction").alias("p"))
    means = dict(values(by_place, "busy", "p"))
    assert means[True] > 0.7 and means[False] < 0.3
    new = scored.limit(1).drop("prediction").withColumn("PULocationID", F.lit("never seen"))
    assert values(model.score(new), "prediction")[0] is not None


@pytest.mark.parametrize("fill", [True, False])
def test_no_trips(spark, fill):
    none = spark.createDataFrame([], "PULocationID int, tpep_pickup_datetime timestamp_ntz")
    with pytest.raises(Exception, match="(?i)empty|size|0"):
        op.fit_demand(none, spec=op.ForestSpec(trees=2, depth=2), fill=fill)
