import pytest
from pyspark.sql import functions as F

from tests.trips import values
from tripkit import operators as op


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(3000).select(
        (i % 97 / 7.0).alias("x"),
        (i % 11).cast("int").alias("h"),
        F.element_at(F.array(*map(F.lit, "abcdefg")), (i % 7 + 1).cast("int")).alias("c"),
        (3.0 * (i % 97 / 7.0) + 10 * (i % 7 == 3).cast("int") + (i % 5)).alias("y"),
    )


@pytest.mark.parametrize("fit, spec", [(op.fit_forest, op.ForestSpec(trees=7, depth=5)), (op.fit_gbt, op.BoostSpec(iterations=6, depth=3))])
def test_the_table_predicts_what_the_model_predicts(rows, fit, spec):
    index = op.learn_index(rows, "c")
    coded = op.with_index(rows, index, "c", "c_idx")
    model = fit(coded, spec, ["x", "h", "c_idx"], "y", category=())
    table = op.tree_table(model)
    assert table.columns == ["tree", "weight", "node", "feature", "threshold", "categories", "left_child", "right_child", "value"]
    # Nodes are numbered from 0 in each tree: the walk takes them by place.
    numbers = table.groupBy("tree").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in numbers.collect())
    # The index carries its mark, so the trees split it as a category.
    assert table.where("feature = 2 AND categories IS NOT NULL").count() > 0
    assert table.where("feature = 2 AND threshold IS NOT NULL").count() == 0
    walked = op.predict_from_table(op.score(model, coded), table, ["x", "h", "c_idx"], spec.depth, "walked")
    assert walked.where(F.abs(F.col("walked") - F.col("prediction")) > 1e-9).count() == 0
    changed = table.withColumn("value", F.col("value") + F.when((F.col("tree") == 0) & F.col("feature").isNull(), 1.0).otherwise(0.0))
    wrong = op.predict_from_table(op.score(model, coded), changed, ["x", "h", "c_idx"], spec.depth, "walked")
    assert wrong.where(F.abs(F.col("walked") - F.col("prediction")) > 1e-9).count() == rows.count()


def test_rounds_end_early_at_equal_error(rows):
    train, test = op.split_by_id(rows.withColumn("id", F.monotonically_increasing_id()), ["id"])
    stopped = op.fit_gbt(train, op.BoostSpec(iterations=40, depth=4, validation=20, tolerance=0.003), ["x", "h", "c"], "y", "c")
    full = op.fit_gbt(train, op.BoostSpec(iterations=40, depth=4), ["x", "h", "c"], "y", "c")
    assert len(stopped.stages[-1].trees) < len(full.stages[-1].trees) == 40
    both = op.score(full, op.score(stopped, test, "s"), "f")
    errors = dict(values(op.compare_models(both, "y", {"s": "s", "f": "f"}), "model", "rmse"))
    assert errors["s"] < 1.1 * errors["f"]
