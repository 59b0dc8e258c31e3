"""Benchmark: prints one JSON line with the median seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all),
BENCH_REPEATS (default 5), BENCH_SCRATCH (a folder for the stored trips that all executors share;
default: beside the checkpoints). Each query is planned and run to the end into a sink that keeps
nothing; two unmeasured runs come first. Models are fitted once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import uuid
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tripkit import operators as op  # noqa: E402
from tripkit import plans  # noqa: E402
from tripkit.plans import register  # noqa: E402
from tripkit.sources import read_table, read_trips, session, union_months  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "*")
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))
SWEEP = (1, 4, 8, 16, 32, 64)
MONTHS = 5
COPIES = 30

NAMED = (
    "row_count",
    "summarize",
    "distribution",
    "count_by_hour",
    "peak_avg_hour",
    "topk_by_count",
    "topk_by_sum",
    "avg_by_key",
    "relayout_avg",
    "relayout_by_key_avg",
    "demand_table",
    "sql_topk_by_count",
    "having_avg_gt",
    "outlier_groups",
    "quality_report",
    "removal_report",
    "features",
    "union_months",
    "hash_split",
    "regression_metrics",
    "category_index",
    "revenue_vs_volume",
    "cached_avg",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(run: Callable[[], None], repeats: int = REPEATS, warm: int = 2) -> float:
    for _ in range(warm):
        run()
    taken = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 4)


def separate_counts(trips) -> None:
    """The report's counts as one job per rule, for comparison with the single pass."""
    for rule in op.trip_rules():
        drain(op.row_count(trips.where(rule.bad)))


def main() -> None:
    spark = session(
        "tripkit-bench", master=f"local[{CPUS}]", driver_memory="8g", conf={"spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = plans.queries()
    times: dict[str, float] = {}
    for name in NAMED:
        times[name] = seconds(lambda: drain(known[name](spark, FOLDER)))

    lineitem = read_table(spark, FOLDER, "lineitem").select("l_suppkey", "l_extendedprice")
    average = register.avg_price_by_supplier
    with op.cached(lineitem) as held:
        held.count()
        times["avg_by_key_cached"] = seconds(lambda: drain(average(held)))
    # The same table several times over: how the aggregation grows with the number of months.
    months = union_months([lineitem] * MONTHS)
    times[f"avg_by_key_{MONTHS}_months"] = seconds(lambda: drain(average(months)))
    with op.cached(months) as held:
        held.count()
        times[f"avg_by_key_{MONTHS}_months_cached"] = seconds(lambda: drain(average(held)))
    # The layout experiment on about three million trips: clean, derive, average by place.
    copies = union_months([register.trips(spark, FOLDER)] * COPIES)
    scratch = os.environ.get("BENCH_SCRATCH") or op.ensure_checkpoint_dir(spark)
    stored = f"{scratch}/bench-trips-{uuid.uuid4()}"
    op.relayout(copies, spark.sparkContext.defaultParallelism).write.parquet(stored)
    tidy = op.filter_duration(op.with_features(op.clean(read_trips(spark, stored), op.trip_rules())))

    def by_place(df) -> None:
        drain(op.avg_by_key(df, "PULocationID", "fare_amount"))

    times["layout_original"] = seconds(lambda: by_place(tidy))
    times["layout_repartitioned"] = seconds(lambda: by_place(op.relayout(tidy, 16)))
    with op.cached(tidy) as held:
        held.count()
        times["layout_cached"] = seconds(lambda: by_place(held))
    sweep = {n: seconds(lambda: drain(average(op.relayout(lineitem, n)))) for n in SWEEP}

    # One pass for all rules against one job per rule, on the same rows in the same state.
    trips = union_months([register.trips(spark, FOLDER)] * MONTHS)
    one_pass, many_jobs = (lambda: drain(op.quality_report(trips, op.trip_rules()))), (lambda: separate_counts(trips))
    many_jobs()
    comparison = {"quality_report_one_pass": seconds(one_pass), "quality_report_job_per_rule": seconds(many_jobs)}

    # Little input, much work per row: spread it over the cores. Large inputs have parts enough.
    train, test = (
        op.relayout(part, spark.sparkContext.defaultParallelism) for part in register.signal_split(spark, FOLDER)
    )
    models = {}

    def fit(name, fitter):
        models[name] = fitter(train)

    label = register.SIGNAL
    times["fit_forest_50x8"] = seconds(
        lambda: fit("forest", lambda t: op.fit_forest(t, label=label)), repeats=1, warm=0
    )
    times["fit_forest_50x8_keep_nodes"] = seconds(
        lambda: fit("forest", lambda t: op.fit_forest(t, op.ForestSpec(keep_nodes=True), label=label)), repeats=1, warm=0
    )
    times["fit_gbt_50x6"] = seconds(lambda: fit("gbt", lambda t: op.fit_gbt(t, label=label)), repeats=1, warm=0)
    both = op.score(models["gbt"], op.score(models["forest"], test, "by_forest"), "by_gbt")
    named = {"forest": "by_forest", "gbt": "by_gbt"}
    times["compare_models"] = seconds(lambda: drain(op.compare_models(both, label, named)), repeats=1)

    lines = read_table(spark, FOLDER, "lineitem").count()
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": Path(FOLDER).name,
                "cpus": CPUS,
                "repeats": REPEATS,
                "lineitem_rows": lines,
                "rows_per_sec_avg_by_key_months": round(MONTHS * lines / times[f"avg_by_key_{MONTHS}_months"]),
                "partition_sweep": sweep,
                "comparison": comparison,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
