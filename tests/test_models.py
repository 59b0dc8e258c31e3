import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from tests.trips import values
from tripkit import operators as op


@pytest.fixture(scope="module")
def planted(spark):
    """Fares that follow distance and, less, duration."""
    i = F.col("id")
    distance = 0.5 + (i * 37 % 591) / 20.0
    minutes = 3.0 + i * 53 % 88
    return (
        spark.range(4000)
        .select(
            i.alias("event_id"),
            distance.alias("trip_distance"),
            (1 + i % 6).alias("passenger_count"),
            minutes.alias("trip_duration_min"),
            (i % 24).cast("int").alias("pickup_hour"),
            F.element_at(F.array(*map(F.lit, ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])), (i % 7 + 1).cast("int")).alias("day_of_week"),
            (3 + 2.5 * distance + 0.5 * minutes + (i % 5) * 0.2).alias("fare_amount"),
        )
        .cache()
    )


@pytest.fixture(scope="module")
def parts(planted):
    return op.split_by_id(op.training_frame(planted, ids=["event_id"]), ["event_id"])


@pytest.fixture(scope="module")
def forest(parts):
    return op.fit_forest(parts[0], op.ForestSpec(trees=20, depth=8))


@pytest.fixture(scope="module")
def boosted(parts):
    return op.fit_gbt(parts[0], op.BoostSpec(iterations=10, depth=4))


def test_split_is_disjoint_complete_and_stable(planted, parts):
    train, test = parts
    assert train.count() + test.count() == planted.count()
    assert train.join(test, "event_id", "left_semi").count() == 0
    assert 0.75 < train.count() / planted.count() < 0.85
    again, _rest = op.split_by_id(planted.repartition(11), ["event_id"])
    op.assert_same(again.select("event_id"), train.select("event_id"))
    flagged = op.hash_split(planted, ["event_id"]).where("is_train")
    op.assert_same(flagged.select("event_id"), train.select("event_id"))


def test_random_split(planted):
    train, test = op.random_split(planted)
    assert train.count() + test.count() == planted.count()
    assert 0.7 < train.count() / planted.count() < 0.9


def test_training_frame_drops_rows_with_nulls(planted):
    holes = planted.withColumn("passenger_count", F.when(F.col("event_id") % 4 != 0, F.col("passenger_count")))
    frame = op.training_frame(holes)
    assert frame.columns == [*op.FARE_FEATURES, "fare_amount"]
    assert frame.count() == 3000


def test_forest_finds_the_signal(forest, parts):
    metrics = op.regression_metrics(op.score(forest, parts[1]), "fare_amount").first()
    assert metrics["n"] == parts[1].count()
    assert metrics["r2"] > 0.9
    importances = dict(values(op.feature_importances(forest)))
    assert list(importances) == [f"{c}_idx" if c == "day_of_week" else c for c in op.FARE_FEATURES]
    assert max(importances, key=importances.get) == "trip_distance"
    assert sum(importances.values()) == pytest.approx(1.0)


def test_comparison_equals_single_metrics(forest, boosted, parts):
    by_forest = op.score(forest, parts[1], "by_forest")
    both = op.score(boosted, by_forest, "by_gbt")
    assert set(both.columns) == {*parts[1].columns, "by_forest", "by_gbt"}
    rows = {r["model"]: tuple(r)[1:] for r in op.compare_models(both, "fare_amount", {"forest": "by_forest", "gbt": "by_gbt"}).collect()}
    assert rows["forest"] == pytest.approx(tuple(op.regression_metrics(by_forest, "fare_amount", "by_forest").first()))
    assert rows["gbt"] == pytest.approx(tuple(op.regression_metrics(both, "fare_amount", "by_gbt").first()))
    assert rows["gbt"][3] > 0.9


def test_metrics_equal_the_evaluator(forest, parts):
    scored = op.score(forest, parts[1])
    ours = op.regression_metrics(scored, "fare_amount").first()
    for name in ("rmse", "mae", "r2"):
        evaluator = RegressionEvaluator(labelCol="fare_amount", predictionCol="prediction", metricName=name)
        assert ours[name] == pytest.approx(evaluator.evaluate(scored), rel=1e-9)


def test_metrics_skip_unknown_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (4.0, None)], "y double, p double")
    n, rmse, mae, r2 = op.regression_metrics(df, "y", "p").first()
    assert (n, mae) == (2, 0.5)
    assert rmse == pytest.approx(0.5**0.5)
    assert r2 == pytest.approx(1 - 1 / 2)
    odd = df.unionAll(spark.createDataFrame([(float("nan"), 1.0), (2.0, float("nan"))], df.schema))
    assert op.regression_metrics(odd, "y", "p").first() == op.regression_metrics(df, "y", "p").first()
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert op.regression_metrics(same, "y", "p").first()["r2"] is None


def test_unseen_category_can_be_scored(forest, parts):
    odd = parts[1].limit(3).withColumn("day_of_week", F.lit("Never"))
    assert op.score(forest, odd).where("prediction is not null").count() == 3


def test_fit_leaves_no_cache(spark, forest, boosted, parts):
    assert not parts[0].select(*op.FARE_FEATURES, "fare_amount").storageLevel.useMemory


def test_residual_anomalies(spark):
    rows = [(i, 10.0, 10.0 + (i % 2) * 0.1) for i in range(50)] + [(99, 50.0, 10.0)]
    df = spark.createDataFrame(rows, "event_id int, y double, prediction double")
    assert values(op.residual_anomalies(df, "y"), "event_id") == [99]
    nan = spark.createDataFrame([(100, float("nan"), 10.0), (101, 10.0, None)], df.schema)
    assert values(op.residual_anomalies(df.unionAll(nan), "y"), "event_id") == [99]


def test_demand_model(spark):
    i = F.col("id")
    trips = spark.range(6000).select(
        (i % 3 + 1).cast("int").alias("PULocationID"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (i * i % 667).cast("int"))).alias(
            "tpep_pickup_datetime"
        ),
    )
    model, scored = op.fit_demand(trips, spec=op.ForestSpec(trees=5, depth=4))
    assert model.stages[-1].getNumTrees == 5
    assert {"trip_count", "prediction"} <= set(scored.columns)
    metrics = op.regression_metrics(scored, "trip_count").first()
    assert metrics["n"] > 0 and metrics["rmse"] >= 0
    named = trips.withColumn("PULocationID", F.concat(F.lit("place "), "PULocationID"))
    _model, filled = op.fit_demand(named, spec=op.ForestSpec(trees=3, depth=3, keep_nodes=True), fill=True)
    assert filled.where("trip_count = 0").count() > 0


def test_filled_demand_has_every_cell_and_counts_per_day(spark):
    rows = [("a", "2024-01-01 05:00:00"), ("a", "2024-01-08 05:30:00"), ("a", "2024-01-09 05:30:00"), (None, "2024-01-06 23:59:59"), ("a", None)]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    cells = op.demand_table_filled(df, "k", "t")
    assert cells.count() == 2 * 24 * 7
    found = {(r["k"], r["pickup_hour"], r["day_of_week"]): tuple(r)[3:] for r in cells.where("n > 0").collect()}
    assert found == {("a", 5, "Mon"): (0, 2, 2, 1.0), ("a", 5, "Tue"): (0, 1, 1, 1.0), (None, 23, "Sat"): (1, 1, 1, 1.0)}
    assert cells.where("day_of_week = 'Sun' and days = 0 and per_day is null and is_weekend = 1").count() == 48
