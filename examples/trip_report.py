"""A whole analysis of trip files, from profile to demand model.

    spark-submit examples/trip_report.py --checkpoint-dir hdfs:///tmp/trips --out hdfs:///reports \\
        trips/2024-01.parquet [trips/2024-02.parquet ...]

Several files are taken as months and joined by column name. Every report is written in full
as Parquet to a folder of its own under ``--out``, and its first rows are printed.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tripkit import Roles  # noqa: E402
from tripkit import operators as op  # noqa: E402
from tripkit.sources import read_months, schema_table  # noqa: E402

Show = Callable[[str, DataFrame], None]
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
PRINTED = 20


def writer(out: str) -> Show:
    """Reports go to ``out``, whole; the first rows of each are printed from there."""

    def report(title: str, df: DataFrame) -> None:
        path = f"{out}/{title.replace(' ', '_')}"
        df.write.mode("overwrite").parquet(path)
        print(f"\n== {title}: the first rows of {path}")
        df.sparkSession.read.parquet(path).show(PRINTED, truncate=False)

    return report


def measures_of(trips: DataFrame) -> list[str]:
    """The numeric columns whose names are no ids."""
    return [name for name, kind in trips.dtypes if (kind in NUMBERS or kind.startswith("decimal")) and not name.endswith("ID")]


def explore(trips: DataFrame, roles: Roles, report: Show) -> None:
    report("columns", schema_table(trips))
    report("some trips", op.sample_rows(trips))
    # Rows, every measure and every rule in one scan.
    report("profile", op.profile(trips, measures_of(trips), op.trip_rules(roles)))
    report("rows per partition", op.partition_profile(trips))
    report("passenger counts", op.distribution(trips, roles.party))
    report("trips by hour", op.count_by_hour(trips, roles.start))
    report("busiest hour", op.peak_hour(trips, roles.start))
    report("dearest hour", op.peak_avg_hour(trips, roles.start, roles.amount))
    report("places by trips", op.topk_by_count(trips, roles.place))
    report("places by revenue", op.topk_by_sum(trips, roles.place, roles.amount))


def explore_in_sql(trips: DataFrame, roles: Roles, report: Show) -> None:
    averages = op.sql_avgs_by_key(
        trips, roles.party, roles.amount, roles.distance, first_as="avg_fare", second_as="avg_distance"
    )
    report("averages by passenger count", averages)
    by_trips = op.sql_topk_by_count(trips, roles.place)
    report("places by trips in SQL", by_trips)
    report("trips by hour in SQL", op.sql_count_by_hour(trips, roles.start))
    report("fare by hour", op.sql_avg_by_hour(trips, roles.start, roles.amount))
    report("unusually dear places", op.outlier_groups(trips, roles.place, roles.amount))
    report("both APIs agree", op.parity(op.topk_by_count(trips, roles.place), by_trips))


def tidy(trips: DataFrame, roles: Roles, report: Show) -> DataFrame:
    rules = op.trip_rules(roles)
    report("suspicious rows", op.quality_report(trips, rules))
    return op.filter_duration(op.with_features(op.clean(trips, rules), roles))


def model_fares(trips: DataFrame, ids: list[str], forest: op.ForestSpec, boost: op.BoostSpec, report: Show) -> None:
    used = {*op.FARE_FEATURES, "fare_amount"}
    frame = op.training_frame(trips, ids=[i for i in ids if i not in used])
    train, test = op.split_by_id(frame, ids)
    # The caller holds these columns in its cache already.
    grown, boosted = op.fit_forest(train, forest, cache=False), op.fit_gbt(train, boost, cache=False)
    report("importances", op.feature_importances(grown))
    both = op.score(boosted, op.score(grown, test, "by_forest"), "by_gbt")
    report("models", op.compare_models(both, "fare_amount", {"forest": "by_forest", "gbt": "by_gbt"}))
    report("fares far off the prediction", op.residual_anomalies(both, "fare_amount", "by_forest"))


def run(
    spark: SparkSession,
    paths: list[str],
    report: Show,
    forest: op.ForestSpec = op.ForestSpec(),
    boost: op.BoostSpec = op.BoostSpec(),
) -> None:
    # Before the first scan, not after the fifteenth: intermediate rows need a shared folder.
    print(f"checkpoints go to {op.ensure_checkpoint_dir(spark)}")
    roles = Roles()
    trips = read_months(spark, paths)
    explore(trips, roles, report)
    explore_in_sql(trips, roles, report)
    tidied = tidy(trips, roles, report)
    # Trips carry no id: start, place and amounts together tell them apart.
    ids = [roles.start, roles.place, roles.distance, roles.amount]
    wanted = dict.fromkeys([*ids, *op.FARE_FEATURES, *op.DEMAND_FEATURES])
    with op.cached(tidied.select(*wanted)) as held:
        report("fare by place", op.avg_by_key(held, roles.place, roles.amount))
        report("weekdays and weekends", op.weekend_split(held, roles.start, roles.amount))
        report("revenue and volume", op.revenue_vs_volume(held, roles.place, roles.amount))
        model_fares(held, ids, forest, boost, report)
        _model, scored = op.fit_demand(held, roles.place, roles.start)
        report("demand model", op.regression_metrics(scored, "trip_count"))


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--out", required=True, help="folder for the reports")
    parser.add_argument("--checkpoint-dir", help="folder that all executors share; default: spark.checkpoint.dir")
    parser.add_argument("--trees", type=int, default=50)
    parser.add_argument("--rounds", type=int, default=50)
    args = parser.parse_args()
    session = SparkSession.builder.appName("trip-report").getOrCreate()
    if args.checkpoint_dir:
        session.sparkContext.setCheckpointDir(args.checkpoint_dir)
    run(
        session,
        args.paths,
        writer(args.out),
        op.ForestSpec(trees=args.trees),
        op.BoostSpec(iterations=args.rounds),
    )
