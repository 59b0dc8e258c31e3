"""Fitted trees as a table, and predictions from that table alone."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripkit.functions import free_name
from tripkit.operators.layout import ensure_checkpoint_dir


def tree_table(model: PipelineModel) -> DataFrame:
    """``(tree, weight, node, feature, threshold, categories, left_child, right_child, value)`` of a fitted ensemble.

    A row whose ``feature`` (its place in the vector) is NULL is a leaf. At another node a row
    goes left if its value is at most ``threshold``, or one of ``categories`` for a category.
    The prediction is the sum of weight times value of the leaves reached. The learner's own
    stored form is written to the checkpoint folder and read from there, so the trees never pass
    through the driver.
    """
    learner = model.stages[-1]
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4()}"
    learner.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    share = 1.0 / learner.getNumTrees if isinstance(learner, RandomForestRegressionModel) else 1.0
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner, nominal = node["leftChild"] >= 0, split["numCategories"] >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner & ~nominal, F.get(split["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.when(inner & nominal, split["leftCategoriesOrThreshold"]).alias("categories"),
        F.when(inner, node["leftChild"]).alias("left_child"),
        F.when(inner, node["rightChild"]).alias("right_child"),
        node["prediction"].alias("value"),
    )
    # One row per tree.
    joined = nodes.join(F.broadcast(weights), "tree")
    return joined.select("tree", (F.col("weight") * share).alias("weight"), *nodes.columns[1:])


# What a tree is while rows walk through it: one array per property, by node number.
_PROPERTIES = ("feature", "threshold", "categories", "left_child", "right_child", "value")


def _of(name: str) -> Callable[[Column], Column]:
    return lambda node: node[name]


def predict_from_table(df: DataFrame, table: DataFrame, features: Sequence[str], depth: int, out: str) -> DataFrame:
    """Add the prediction that the trees of ``table`` give, by built-in expressions.

    ``features`` are the columns in the vector's order, categories as their index. ``depth`` is
    at least the depth of the trees. The ensemble has at most ``2 ** (depth + 1)`` nodes a tree, which bounds
    the one row it is gathered in; each row of ``df`` walks down all trees where it is.
    """
    packed = F.array_sort(F.collect_list(F.struct("node", *_PROPERTIES)))
    per_tree = table.groupBy("tree", "weight").agg(packed.alias("nodes"))
    lists = [F.transform("nodes", _of(name)).alias(name) for name in _PROPERTIES]
    ensemble = per_tree.select(F.struct("tree", "weight", *lists).alias("t")).agg(F.array_sort(F.collect_list("t"))).scalar()
    x = F.array(*[F.col(name).cast("double") for name in features])

    def walk(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            def own(name: str) -> Column:
                return F.get(tree[name], at)

            value = F.get(x, own("feature"))
            goes_left = F.when(own("categories").isNotNull(), F.array_contains(own("categories"), value)).otherwise(value <= own("threshold"))
            return F.when(own("feature").isNull(), at).when(goes_left, own("left_child")).otherwise(own("right_child"))

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
        return tree["weight"] * F.get(tree["value"], leaf)

    trees = free_name("trees", df.columns)
    total = F.aggregate(trees, F.lit(0.0), lambda total, tree: total + walk(tree))
    return df.withColumn(trees, ensemble).withColumn(out, total).drop(trees)
