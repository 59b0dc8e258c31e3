"""Regression on DataFrames with the distributed tree learners of Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripkit.functions import free_name, hash_share
from tripkit.operators.encoding import CategoryCodes, category_codes
from tripkit.operators.explore import demand_table
from tripkit.operators.layout import cached, checkpointed, ensure_checkpoint_dir
from tripkit.operators.panel import demand_panel, time_split
from tripkit.operators.quality import drop_nulls

# The columns that predict a fare and the demand of a place, in vector order.
FARE_FEATURES = ("trip_distance", "passenger_count", "trip_duration_min", "pickup_hour", "day_of_week")
DEMAND_FEATURES = ("PULocationID", "pickup_hour", "day_of_week", "is_weekend")
DEMAND_LABEL = "trip_count"
CATEGORY = "day_of_week"
VECTOR = "features"


@dataclass(frozen=True)
class ForestSpec:
    """Size of a forest. ``keep_nodes`` stores every row's node in every tree between levels,
    four bytes a tree and row, instead of walking down from the roots again."""

    trees: int = 50
    depth: int = 8
    seed: int = 42
    keep_nodes: bool = False


@dataclass(frozen=True)
class BoostSpec:
    """Size of a boosted ensemble. ``validation`` is the percentage of the training rows that decide
    when to stop (0: none, all rounds are run); a round must better their error by the share ``tolerance``."""

    iterations: int = 50
    depth: int = 6
    seed: int = 42
    validation: float = 0.0
    tolerance: float = 0.01


# The demand forest has the learner's usual depth.
DEMAND_SPEC = ForestSpec(depth=5)


def training_frame(
    df: DataFrame,
    features: Sequence[str] = FARE_FEATURES,
    label: str = "fare_amount",
    ids: Sequence[str] = (),
) -> DataFrame:
    """Inputs and label of the rows that have all of them; ``ids`` come along unchecked."""
    needed = [*features, label]
    return drop_nulls(df.select(*ids, *needed), needed)


def hash_split(
    df: DataFrame, id_cols: Sequence[str], pct: int = 80, seed: int = 42, out: str = "is_train"
) -> DataFrame:
    """Add a flag that is true for about ``pct`` percent of the ids, the same ones in every run."""
    return df.withColumn(out, hash_share(*id_cols, pct=pct, seed=seed))


def split_by_id(
    df: DataFrame, id_cols: Sequence[str], pct: int = 80, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by ``hash_split``: disjoint, complete, and stable under repartitioning."""
    chosen = hash_share(*id_cols, pct=pct, seed=seed)
    return df.where(chosen), df.where(~chosen)


def random_split(df: DataFrame, pct: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by a random draw, for rows without an id. Depends on the partitioning."""
    train, test = df.randomSplit([float(pct), float(100 - pct)], seed=seed)
    return train, test


def index_stage(category: str = CATEGORY) -> StringIndexer:
    """Category to index by falling frequency; a category unseen in training gets an extra index.

    The categories are gathered on the driver, and the tree learners take 32 at most: weekdays
    or event types, not ids.
    """
    return StringIndexer(inputCol=category, outputCol=f"{category}_idx", handleInvalid="keep")


def vector_stage(features: Sequence[str], *categories: str) -> VectorAssembler:
    """Feature columns to one vector, categories by their index."""
    return VectorAssembler(
        inputCols=[f"{name}_idx" if name in categories else name for name in features], outputCol=VECTOR
    )


def _fit(
    train: DataFrame,
    features: Sequence[str],
    category: str | Sequence[str],
    learner,
    cache: bool,
    also: Sequence[str] = (),
) -> PipelineModel:
    # Fitting passes over its input several times (labels, split points, bagging): hold the
    # few columns it needs instead of reading and deriving them again each time.
    ensure_checkpoint_dir(train.sparkSession)
    inputs = train.select(*features, learner.getLabelCol(), *also)
    categories = [category] if isinstance(category, str) else list(category)
    stages = [*map(index_stage, categories), vector_stage(features, *categories), learner]
    pipeline = Pipeline(stages=stages)
    with cached(inputs) if cache else nullcontext(inputs) as held:
        return pipeline.fit(held)


def fit_forest(
    train: DataFrame,
    spec: ForestSpec = ForestSpec(),
    features: Sequence[str] = FARE_FEATURES,
    label: str = "fare_amount",
    category: str | Sequence[str] = CATEGORY,
    cache: bool = True,
) -> PipelineModel:
    """Random-forest regression; ``category`` names the string column or columns among the features.

    Rows in few or uneven partitions should go through ``relayout`` first: every level passes
    over all of them.
    """
    learner = RandomForestRegressor(
        featuresCol=VECTOR,
        labelCol=label,
        numTrees=spec.trees,
        maxDepth=spec.depth,
        seed=spec.seed,
        cacheNodeIds=spec.keep_nodes,
    )
    return _fit(train, features, category, learner, cache)


def fit_gbt(
    train: DataFrame,
    spec: BoostSpec = BoostSpec(),
    features: Sequence[str] = FARE_FEATURES,
    label: str = "fare_amount",
    category: str | Sequence[str] = CATEGORY,
    cache: bool = True,
) -> PipelineModel:
    """Gradient-boosted trees; the growing lineage is cut in the checkpoint folder every few rounds.

    With ``spec.validation`` a share of the training rows, chosen by a hash of inputs and label, is
    not learned from but judges each round, and rounds end once it gains no more: the model
    keeps the best number of trees so far, at most ``spec.iterations``.
    """
    learner = GBTRegressor(
        featuresCol=VECTOR,
        labelCol=label,
        maxIter=spec.iterations,
        maxDepth=spec.depth,
        seed=spec.seed,
        checkpointInterval=5,
        validationTol=spec.tolerance,
    )
    if not spec.validation:
        return _fit(train, features, category, learner, cache)
    judge = free_name("judges", train.columns)
    drawn = F.pmod(F.xxhash64(F.lit(spec.seed), *features, label), F.lit(1000)) < round(10 * spec.validation)
    learner.setValidationIndicatorCol(judge)
    return _fit(train.withColumn(judge, drawn), features, category, learner, cache, [judge])


def score(model: PipelineModel, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Add the prediction only; the pipeline's helper columns are dropped, so scores can be chained."""
    *indexes, vector, learner = model.stages
    scored = model.transform(df)
    helpers = [index.getOutputCol() for index in indexes]
    return scored.drop(*helpers, vector.getOutputCol()).withColumnRenamed(
        learner.getPredictionCol(), prediction
    )


def _metrics(label: Column, prediction: Column) -> dict[str, Column]:
    error = (label - prediction).cast("double")
    known = error.isNotNull() & ~F.isnan(error)
    error, label = F.when(known, error), F.when(known, label)
    n = F.count(error)
    return {
        "n": n,
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": 1 - F.try_divide(F.sum(error * error), F.var_pop(label) * n),
    }


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """``(n, rmse, mae, r2)`` in one aggregation, over rows that have label and prediction.

    Rows where either is NULL or NaN are left out of all four.
    """
    return df.agg(*[m.alias(name) for name, m in _metrics(F.col(label), F.col(prediction)).items()])


def compare_models(df: DataFrame, label: str, predictions: Mapping[str, str]) -> DataFrame:
    """``(model, n, rmse, mae, r2)`` for several prediction columns of the same rows, in one pass."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(model).alias("model"),
                *[m.alias(name) for name, m in _metrics(F.col(label), F.col(prediction)).items()],
            ).alias(f"model_{position}")
            for position, (model, prediction) in enumerate(predictions.items())
        ]
    )
    return wide.select(F.inline(F.array(*wide.columns)))


def feature_importances(model: PipelineModel) -> DataFrame:
    """``(feature, importance)``, one row per input of the fitted trees."""
    *_, vector, learner = model.stages
    rows = list(zip(vector.getInputCols(), [float(x) for x in learner.featureImportances.toArray()]))
    layout = T.StructType(
        [T.StructField("feature", T.StringType(), False), T.StructField("importance", T.DoubleType(), False)]
    )
    return SparkSession.active().createDataFrame(rows, layout)


def residual_anomalies(df: DataFrame, label: str, prediction: str = "prediction", k: float = 3.0) -> DataFrame:
    """Rows whose label is more than ``k`` sample deviations of the residuals off its prediction.

    Runs when called: the rows are computed once and checkpointed, so that a model is not applied
    again for the deviation. Residuals that are NULL or NaN neither count nor are reported.
    """
    rows = checkpointed(df)
    plain = (F.col(label) - F.col(prediction)).cast("double")
    residual = F.when(~F.isnan(plain), plain)
    deviation = rows.agg(F.stddev_samp(residual)).scalar()
    return rows.where(F.abs(residual) > k * deviation)


@dataclass(frozen=True)
class DemandModel:
    """A forest over coded keys, hours and weekdays, with the codes of its keys."""

    pipeline: PipelineModel
    codes: CategoryCodes

    @property
    def stages(self) -> list:
        return self.pipeline.stages

    def score(self, cells: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Cells of key, ``pickup_hour``, ``day_of_week`` and ``is_weekend`` with their predicted trips.

        A key without training cells is predicted like an average one.
        """
        code = f"{self.codes.column}_code"
        return score(self.pipeline, self.codes.add(cells, code), prediction).drop(code)


def fit_demand(
    trips: DataFrame,
    key: str = "PULocationID",
    ts: str = "tpep_pickup_datetime",
    spec: ForestSpec = DEMAND_SPEC,
    pct: int = 80,
    seed: int = 42,
    fill: bool = True,
) -> tuple[DemandModel, DataFrame]:
    """Forest for the trips per key, hour and weekday; returns it with the scored test cells.

    The cells are those of ``demand_panel``: trips per key in one hour of one day, zeros included.
    The first ``pct`` percent of the days train, the later ones test. Without ``fill`` cells are the
    totals of each key, hour and weekday that occurs (``demand_table``), split by a hash.

    The key enters as its target-mean code (``category_codes``), learned from the training cells,
    so it may be of any type and have millions of values. Cells are counted once and checkpointed.
    """
    hour, weekday, weekend = DEMAND_FEATURES[1:]
    if fill:
        cells = checkpointed(demand_panel(trips, key, ts, count_as=DEMAND_LABEL))
        train, test = time_split(cells, pct)
    else:
        table = demand_table(trips, key, ts, count_as=DEMAND_LABEL)
        cells = checkpointed(drop_nulls(table.select(key, hour, weekday, weekend, DEMAND_LABEL)))
        train, test = split_by_id(cells, [key, hour, weekday], pct, seed)
    codes = category_codes(train, key, DEMAND_LABEL)
    code = f"{key}_code"
    features = [code, hour, weekday, weekend]
    model = DemandModel(fit_forest(codes.add(train, code), spec, features, DEMAND_LABEL, CATEGORY), codes)
    return model, model.score(test)
