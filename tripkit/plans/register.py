"""Every operator bound to the test tables, next to the SQL that must give the same rows.

Sums of doubles depend on the order of addition. Money is therefore bound as whole cents, as long
integers: sums are exact in any order, and averages are those of exact sums. Deviations and the metrics of models are compared at four decimals. Row-local arithmetic is
the same in both engines and is compared as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripkit import operators as op
from tripkit.sources import read_stored_months, read_table, store_months, trips_from_events, union_months

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"
MONTH_BREAK = "2024-01-16"

TRIPS_SQL = """trips AS (
  SELECT event_id,
         ts AS tpep_pickup_datetime,
         ts + to_minutes(CAST(event_id % 263 AS INT) - 5) AS tpep_dropoff_datetime,
         CAST(CASE WHEN event_id % 21 = 0 THEN NULL ELSE event_id % 8 END AS BIGINT) AS passenger_count,
         CAST(json_extract_string(props, '$.k') AS INT) * CAST(1.02 AS DOUBLE) AS trip_distance,
         CASE WHEN event_id % 37 = 0 THEN -value
              WHEN event_id % 53 = 0 THEN value * 10
              ELSE value END AS fare_amount,
         CAST(CASE WHEN event_id % 53 = 0 THEN 900 + user_id % 5 ELSE user_id END AS INT) AS "PULocationID"
  FROM events)"""
# The rules by name, as the operators have them.
RULES_SQL = {
    "zero_or_negative_distance": "trip_distance <= 0",
    "zero_or_negative_fare": "fare_amount <= 0",
    "invalid_passenger_count": "passenger_count <= 0 OR passenger_count > 6",
    "extremely_long_distance": "trip_distance > 100",
    "extremely_large_fare": "fare_amount > 500",
    "invalid_timestamps": "tpep_dropoff_datetime <= tpep_pickup_datetime",
}
CLEANED_SQL = f"""{TRIPS_SQL},
cleaned AS (SELECT * FROM trips WHERE {" AND ".join(f"NOT ({bad})" for bad in RULES_SQL.values())})"""
FEATURES_SQL = f"""{CLEANED_SQL},
featured AS (
  SELECT *, trip_distance / (trip_duration_min / 60.0::DOUBLE) AS avg_speed_mph
  FROM (
    SELECT *,
           date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0::DOUBLE AS trip_duration_min,
           CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
           strftime(tpep_pickup_datetime, '%a') AS day_of_week,
           CAST(dayofweek(tpep_pickup_datetime) IN (0, 6) AS INTEGER) AS is_weekend,
           fare_amount / trip_distance AS fare_per_mile
    FROM cleaned)
  WHERE trip_duration_min > 0 AND trip_duration_min < 240)"""
HOUR_MEANS_SQL = f"""{FEATURES_SQL},
predicted AS (
  SELECT event_id, fare_amount AS y,
         avg(fare_amount) OVER (PARTITION BY pickup_hour) AS p
  FROM featured)"""


def r(expression: str) -> str:
    """SQL text of a deviation or a metric at comparison precision."""
    return f"round({expression}, 4)"


def cents_sql(column: str) -> str:
    """SQL text of an amount in whole cents."""
    return f"CAST(floor(CAST({column} AS DOUBLE) * 100 + 0.5) AS BIGINT)"


def avg_sql(column: str) -> str:
    """SQL text of the average of whole cents, as an amount."""
    return f"(CAST(sum({cents_sql(column)}) AS DOUBLE) / count({column}) / 100.0::DOUBLE)"


def sum_sql(column: str) -> str:
    return f"(CAST(sum({cents_sql(column)}) AS DOUBLE) / 100.0::DOUBLE)"


def exact(df: DataFrame, *names: str) -> DataFrame:
    """The named measures as whole cents."""
    return df.withColumns({name: F.floor(F.col(name).cast("double") * 100 + 0.5) for name in names})


def amounts(df: DataFrame, *names: str) -> DataFrame:
    """The named results, in cents, as amounts."""
    return df.withColumns({name: F.col(name) / F.lit(100.0) for name in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """The named columns at comparison precision."""
    return df.withColumns({name: F.round(F.col(name), 4) for name in names})


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def trips(spark: SparkSession, folder: str, distance: bool = True) -> DataFrame:
    return trips_from_events(read_table(spark, folder, "events"), distance)


def cleaned_trips(spark: SparkSession, folder: str) -> DataFrame:
    return op.clean(trips(spark, folder), op.trip_rules())


def featured_trips(spark: SparkSession, folder: str) -> DataFrame:
    return op.filter_duration(op.with_features(cleaned_trips(spark, folder)))


# --- profiling and whole-table aggregates -------------------------------------------------


@register("row_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, folder):
    return op.row_count(read_table(spark, folder, "lineitem"))


@register("sample_rows", "SELECT * FROM events ORDER BY event_id LIMIT 5")
def _(spark, folder):
    return op.sample_rows(read_table(spark, folder, "events"), 5, ["event_id"])


def summary_sql(table: str, columns: list[str], prefix: str = "") -> str:
    return prefix + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, {avg_sql(c)} AS mean, {r(f"stddev_samp({c})")} AS stddev,
        min({cents_sql(c)}) / 100.0::DOUBLE AS "min", max({cents_sql(c)}) / 100.0::DOUBLE AS "max" FROM {table}"""
        for c in columns
    )


LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TRIP_MEASURES = ["trip_distance", "fare_amount", "passenger_count"]
SUMMARY = ("mean", "stddev", "min", "max")


@register("summarize", summary_sql("lineitem", LINE_MEASURES))
def _(spark, folder):
    lines = exact(read_table(spark, folder, "lineitem"), *LINE_MEASURES)
    return rounded(amounts(op.summarize(lines, LINE_MEASURES), *SUMMARY), "stddev")


@register("summarize_trips", summary_sql("trips", TRIP_MEASURES, f"WITH {TRIPS_SQL} "))
def _(spark, folder):
    return rounded(amounts(op.summarize(exact(trips(spark, folder), *TRIP_MEASURES), TRIP_MEASURES), *SUMMARY), "stddev")


def profile_sql() -> str:
    """Every line of the profile as a query of its own."""
    nothing = ", ".join(f'CAST(NULL AS DOUBLE) AS "{name}"' for name in ("mean", "stddev", "min", "max"))
    lines = [
        f"SELECT 'table' AS section, 'rows' AS name, count(*) AS n, {nothing} FROM trips",
        f"SELECT 'table', 'kept', count(*), {nothing} FROM cleaned",
        *(
            f"""SELECT 'measure', '{c}', count({c}), {r(avg_sql(c))}, {r(f"stddev_samp({c})")},
            CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE) FROM trips"""
            for c in TRIP_MEASURES
        ),
        *(f"SELECT 'rule', '{name}', count(*) FILTER ({bad}), {nothing} FROM trips" for name, bad in RULES_SQL.items()),
    ]
    return f"WITH {CLEANED_SQL} " + " UNION ALL ".join(lines)


@register("profile", profile_sql())
def _(spark, folder):
    # The rules compare amounts, not cents.
    return rounded(op.profile(trips(spark, folder), TRIP_MEASURES, op.trip_rules()), "mean", "stddev")


# Fixed value: partitions of the layout experiment.
LAYOUT_PARTITIONS = 16


@register(
    "partition_profile",
    f"SELECT CAST({LAYOUT_PARTITIONS} AS BIGINT) AS partitions, count(*) AS n FROM lineitem",
)
def _(spark, folder):
    per_partition = op.partition_profile(op.relayout(read_table(spark, folder, "lineitem"), LAYOUT_PARTITIONS))
    return per_partition.agg(F.count(F.lit(1)).alias("partitions"), F.sum("n").alias("n"))


def range_sql(column: str, suffix: str) -> str:
    return (
        f"SELECT min({cents_sql(column)}) / 100.0::DOUBLE AS min_{suffix}, "
        f"max({cents_sql(column)}) / 100.0::DOUBLE AS max_{suffix}, {avg_sql(column)} AS avg_{suffix} FROM lineitem"
    )


@register("range_stats_quantity", range_sql("l_quantity", "quantity"))
def _(spark, folder):
    lines = exact(read_table(spark, folder, "lineitem"), "l_quantity")
    return amounts(op.range_stats(lines, "l_quantity", "quantity"), "min_quantity", "max_quantity", "avg_quantity")


@register("range_stats_price", range_sql("l_extendedprice", "price"))
def _(spark, folder):
    lines = exact(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return amounts(op.range_stats(lines, "l_extendedprice", "price"), "min_price", "max_price", "avg_price")


@register("mean_std", f"SELECT {avg_sql('value')} AS mean, {r('stddev_samp(value)')} AS stddev FROM events")
def _(spark, folder):
    return rounded(amounts(op.mean_std(exact(read_table(spark, folder, "events"), "value"), "value"), "mean", "stddev"), "stddev")


# --- grouped aggregates and top-k ---------------------------------------------------------


@register(
    "distribution",
    f"WITH {TRIPS_SQL} SELECT passenger_count, count(*) AS n FROM trips GROUP BY 1 ORDER BY 1 NULLS FIRST",
)
def _(spark, folder):
    return op.distribution(trips(spark, folder, distance=False), "passenger_count")


COUNT_BY_HOUR_SQL = (
    "SELECT CAST(hour(ts) AS INTEGER) AS pickup_hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1"
)
AVG_BY_HOUR_SQL = (
    f"SELECT CAST(hour(ts) AS INTEGER) AS pickup_hour, {avg_sql('value')} AS avg_value FROM events GROUP BY 1"
)


@register("count_by_hour", COUNT_BY_HOUR_SQL)
def _(spark, folder):
    return op.count_by_hour(read_table(spark, folder, "events"), "ts")


@register("peak_hour", COUNT_BY_HOUR_SQL + " LIMIT 1")
def _(spark, folder):
    return op.peak_hour(read_table(spark, folder, "events"), "ts")


@register("avg_by_hour", AVG_BY_HOUR_SQL)
def _(spark, folder):
    return amounts(op.avg_by_hour(exact(read_table(spark, folder, "events"), "value"), "ts", "value"), "avg_value")


@register("peak_avg_hour", AVG_BY_HOUR_SQL + " ORDER BY avg_value DESC, 1 LIMIT 1")
def _(spark, folder):
    return amounts(op.peak_avg_hour(exact(read_table(spark, folder, "events"), "value"), "ts", "value"), "avg_value")


def topk_sql(table: str, key: str, measure: str, out: str) -> str:
    return f"SELECT {key}, {measure} AS {out} FROM {table} GROUP BY {key} ORDER BY {measure} DESC, {key} LIMIT 10"


TOPK_COUNT_SQL = topk_sql("lineitem", "l_suppkey", "count(*)", "n")
TOPK_SUM_SQL = topk_sql("lineitem", "l_suppkey", sum_sql("l_extendedprice"), "total")


@register("topk_by_count", TOPK_COUNT_SQL)
def _(spark, folder):
    return op.topk_by_count(read_table(spark, folder, "lineitem"), "l_suppkey")


@register("topk_by_count_ties", topk_sql("events", "user_id", "count(*)", "n"))
def _(spark, folder):
    return op.topk_by_count(read_table(spark, folder, "events"), "user_id")


@register("topk_by_sum", TOPK_SUM_SQL)
def _(spark, folder):
    lines = exact(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return amounts(op.topk_by_sum(lines, "l_suppkey", "l_extendedprice"), "total")


AVG_BY_KEY_SQL = f"SELECT l_suppkey, {avg_sql('l_extendedprice')} AS avg_price FROM lineitem GROUP BY l_suppkey"


def avg_price_by_supplier(lineitem: DataFrame) -> DataFrame:
    average = op.avg_by_key(exact(lineitem, "l_extendedprice"), "l_suppkey", "l_extendedprice", avg_as="avg_price")
    return amounts(average, "avg_price")


@register("avg_by_key", AVG_BY_KEY_SQL)
def _(spark, folder):
    return avg_price_by_supplier(read_table(spark, folder, "lineitem"))


@register(
    "demand_table",
    """SELECT event_type, CAST(hour(ts) AS INTEGER) AS pickup_hour, strftime(ts, '%a') AS day_of_week,
    CAST(dayofweek(ts) + 1 IN (1, 7) AS INTEGER) AS is_weekend, count(*) AS n
    FROM events GROUP BY 1, 2, 3, 4""",
)
def _(spark, folder):
    return op.demand_table(read_table(spark, folder, "events"), "event_type", "ts")


@register(
    "demand_by_place",
    f"""WITH {FEATURES_SQL} SELECT "PULocationID", pickup_hour, day_of_week, is_weekend, count(*) AS trip_count
    FROM featured GROUP BY 1, 2, 3, 4""",
)
def _(spark, folder):
    return op.demand_table(featured_trips(spark, folder), "PULocationID", PICKUP, count_as="trip_count")


@register(
    "weekend_split",
    f"WITH {FEATURES_SQL} SELECT is_weekend, count(*) AS n, {avg_sql('fare_amount')} AS avg_fare "
    "FROM featured GROUP BY 1",
)
def _(spark, folder):
    rows = exact(featured_trips(spark, folder), "fare_amount")
    return amounts(op.weekend_split(rows, PICKUP, "fare_amount", avg_as="avg_fare"), "avg_fare")


@register(
    "revenue_vs_volume",
    f"""WITH {FEATURES_SQL},
    per_key AS (
      SELECT "PULocationID", count(*) AS n, {sum_sql('fare_amount')} AS total
      FROM featured GROUP BY 1)
    SELECT "PULocationID", n, total,
           row_number() OVER (ORDER BY n DESC, "PULocationID") AS volume_rank,
           row_number() OVER (ORDER BY total DESC, "PULocationID") AS revenue_rank
    FROM per_key""",
)
def _(spark, folder):
    # Exact totals: equal revenues must be equal, or their ranks depend on the order of addition.
    rows = exact(featured_trips(spark, folder), "fare_amount")
    return amounts(op.revenue_vs_volume(rows, "PULocationID", "fare_amount"), "total")


# --- the SQL surface ----------------------------------------------------------------------


@register(
    "sql_avgs_by_key",
    f"WITH {TRIPS_SQL} SELECT passenger_count, {avg_sql('fare_amount')} AS avg_fare, "
    f"{avg_sql('trip_distance')} AS avg_distance FROM trips GROUP BY 1 ORDER BY 1 NULLS FIRST",
)
def _(spark, folder):
    rows = exact(trips(spark, folder), "fare_amount", "trip_distance")
    averages = op.sql_avgs_by_key(rows, "passenger_count", "fare_amount", "trip_distance", "avg_fare", "avg_distance")
    return amounts(averages, "avg_fare", "avg_distance")


@register("sql_topk_by_count", TOPK_COUNT_SQL)
def _(spark, folder):
    return op.sql_topk_by_count(read_table(spark, folder, "lineitem"), "l_suppkey")


@register("sql_topk_by_sum", TOPK_SUM_SQL)
def _(spark, folder):
    lines = exact(read_table(spark, folder, "lineitem"), "l_extendedprice")
    return amounts(op.sql_topk_by_sum(lines, "l_suppkey", "l_extendedprice"), "total")


@register("sql_count_by_hour", COUNT_BY_HOUR_SQL)
def _(spark, folder):
    return op.sql_count_by_hour(read_table(spark, folder, "events"), "ts")


@register("sql_avg_by_hour", AVG_BY_HOUR_SQL + " ORDER BY 1")
def _(spark, folder):
    return amounts(op.sql_avg_by_hour(exact(read_table(spark, folder, "events"), "value"), "ts", "value"), "avg_value")


@register(
    "having_avg_gt",
    f"""SELECT o_custkey, {avg_sql('o_totalprice')} AS avg_price, count(*) AS n FROM orders
    GROUP BY o_custkey HAVING avg(o_totalprice) > 300000 ORDER BY avg(o_totalprice) DESC, o_custkey""",
)
def _(spark, folder):
    orders = exact(read_table(spark, folder, "orders"), "o_totalprice")
    return amounts(op.having_avg_gt(orders, "o_custkey", "o_totalprice", 300000 * 100, "avg_price"), "avg_price")


@register(
    "outlier_groups",
    f"""WITH {TRIPS_SQL}
    SELECT "PULocationID", {avg_sql('fare_amount')} AS avg_fare, count(*) AS n FROM trips
    GROUP BY 1
    HAVING avg(fare_amount) > (SELECT avg(fare_amount) + 2 * stddev_samp(fare_amount) FROM trips)
    ORDER BY avg(fare_amount) DESC, 1""",
)
def _(spark, folder):
    rows = exact(trips(spark, folder, distance=False), "fare_amount")
    return amounts(op.outlier_groups(rows, "PULocationID", "fare_amount", avg_as="avg_fare"), "avg_fare")


def parity_sql(*counts: str) -> str:
    lines = [f"SELECT '{name}' AS report, {n} AS left_rows, {n} AS right_rows, CAST(0 AS BIGINT) AS differing"
             for name, n in (count.split("=") for count in counts)]
    return " UNION ALL ".join(lines)


@register(
    "api_parity",
    parity_sql(
        "count_by_hour=(SELECT count(DISTINCT hour(ts)) FROM events)",
        "avg_by_hour=(SELECT count(DISTINCT hour(ts)) FROM events)",
        "topk_by_count=(SELECT least(10, count(DISTINCT l_suppkey)) FROM lineitem)",
    ),
)
def _(spark, folder):
    events, lineitem = read_table(spark, folder, "events"), read_table(spark, folder, "lineitem")
    pairs = {
        "count_by_hour": (op.count_by_hour(events, "ts"), op.sql_count_by_hour(events, "ts")),
        "avg_by_hour": (
            op.avg_by_hour(exact(events, "value"), "ts", "value"),
            op.sql_avg_by_hour(exact(events, "value"), "ts", "value"),
        ),
        "topk_by_count": (op.topk_by_count(lineitem, "l_suppkey"), op.sql_topk_by_count(lineitem, "l_suppkey")),
    }
    return union_months(
        [op.parity(*pair).select(F.lit(name).alias("report"), "*") for name, pair in pairs.items()]
    )


# --- quality and cleaning -----------------------------------------------------------------


def quality_sql() -> str:
    lines, earlier = [], []
    for name, bad in RULES_SQL.items():
        first = " AND ".join([f"({bad})", *[f"({e}) IS NOT TRUE" for e in earlier]])
        lines.append(
            f"SELECT '{name}' AS rule, count(*) FILTER ({bad}) AS n, count(*) FILTER ({first}) AS n_first FROM trips"
        )
        earlier.append(bad)
    none_true = " AND ".join(f"({e}) IS NOT TRUE" for e in earlier)
    some_null = " OR ".join(f"({e}) IS NULL" for e in earlier)
    unsure = f"count(*) FILTER ({none_true} AND ({some_null}))"
    lines.append(f"SELECT 'null_only' AS rule, {unsure} AS n, {unsure} AS n_first FROM trips")
    return f"WITH {TRIPS_SQL} " + " UNION ALL ".join(lines)


@register("quality_report", quality_sql())
def _(spark, folder):
    return op.quality_report(trips(spark, folder), op.trip_rules())


@register("clean", f"WITH {CLEANED_SQL} SELECT * FROM cleaned")
def _(spark, folder):
    return cleaned_trips(spark, folder)


@register(
    "removal_report",
    f"""WITH {CLEANED_SQL}, counts AS (
      SELECT (SELECT count(*) FROM trips) AS "before", (SELECT count(*) FROM cleaned) AS "after")
    SELECT "before", "after", "before" - "after" AS removed,
           {r('("before" - "after") * 100.0::DOUBLE / "before"')} AS pct
    FROM counts""",
)
def _(spark, folder):
    return rounded(op.removal_report(trips(spark, folder), op.trip_rules()), "pct")


# --- features -----------------------------------------------------------------------------


@register("features", f"WITH {FEATURES_SQL} SELECT event_id, {', '.join(op.FEATURES)} FROM featured")
def _(spark, folder):
    return featured_trips(spark, folder).select("event_id", *op.FEATURES)


PREVIEW = ["event_id", "trip_distance", "fare_amount", *op.FEATURES]


@register("preview", f"WITH {FEATURES_SQL} SELECT {', '.join(PREVIEW)} FROM featured ORDER BY event_id LIMIT 5")
def _(spark, folder):
    return op.sample_rows(featured_trips(spark, folder).select(PREVIEW), 5, ["event_id"])


@register(
    "features_raw",
    f"""WITH {TRIPS_SQL}, timed AS (
      SELECT *, date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0::DOUBLE AS minutes
      FROM trips)
    SELECT event_id,
           CASE WHEN trip_distance <> 0 THEN fare_amount / trip_distance END AS fare_per_mile,
           CASE WHEN minutes > 0 THEN trip_distance / (minutes / 60.0::DOUBLE) END AS avg_speed_mph
    FROM timed""",
)
def _(spark, folder):
    return op.with_features(trips(spark, folder)).select("event_id", "fare_per_mile", "avg_speed_mph")


# --- union, layout, cache -----------------------------------------------------------------


@register("union_months", f"WITH {TRIPS_SQL} SELECT * FROM trips")
def _(spark, folder):
    rows = trips(spark, folder)
    start = F.col(PICKUP)
    first, second = rows.where(start < MONTH_BREAK), rows.where((start >= MONTH_BREAK) | start.isNull())
    return union_months([first, second.select(*reversed(second.columns))])


@register("relayout_avg", AVG_BY_KEY_SQL)
def _(spark, folder):
    return avg_price_by_supplier(op.relayout(read_table(spark, folder, "lineitem"), LAYOUT_PARTITIONS))


@register("relayout_by_key_avg", AVG_BY_KEY_SQL)
def _(spark, folder):
    lineitem = read_table(spark, folder, "lineitem")
    return avg_price_by_supplier(
        op.relayout(lineitem, LAYOUT_PARTITIONS, "l_suppkey", spread=["l_orderkey", "l_linenumber"])
    )


@register("rebalanced_avg", AVG_BY_KEY_SQL)
def _(spark, folder):
    return avg_price_by_supplier(op.relayout(read_table(spark, folder, "lineitem")))


@register(
    "cached_avg",
    " UNION ALL ".join(
        f"SELECT '{key}' AS key, {key} AS id, {avg_sql('l_extendedprice')} AS avg_price FROM lineitem GROUP BY {key}"
        for key in ("l_suppkey", "l_partkey")
    ),
)
def _(spark, folder):
    lines = exact(read_table(spark, folder, "lineitem"), "l_extendedprice")
    kept = op.held(lines.select("l_suppkey", "l_partkey", "l_extendedprice"))
    averages = [
        op.avg_by_key(kept, key, "l_extendedprice", avg_as="avg_price").select(
            F.lit(key).alias("key"), F.col(key).alias("id"), "avg_price"
        )
        for key in ("l_suppkey", "l_partkey")
    ]
    return op.release_with(amounts(union_months(averages), "avg_price"), kept)


# --- models -------------------------------------------------------------------------------


@register(
    "training_frame",
    f"""WITH {TRIPS_SQL}, timed AS (
      SELECT *, date_diff('second', tpep_pickup_datetime, tpep_dropoff_datetime) / 60.0::DOUBLE AS trip_duration_min,
             CAST(hour(tpep_pickup_datetime) AS INTEGER) AS pickup_hour,
             strftime(tpep_pickup_datetime, '%a') AS day_of_week
      FROM trips)
    SELECT trip_distance, passenger_count, trip_duration_min, pickup_hour, day_of_week, fare_amount
    FROM timed WHERE passenger_count IS NOT NULL""",
)
def _(spark, folder):
    return op.training_frame(op.with_features(trips(spark, folder)))


@register(
    "category_index",
    """SELECT event_type, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) - 1 AS DOUBLE) AS idx
    FROM events GROUP BY event_type""",
)
def _(spark, folder):
    return op.category_index(read_table(spark, folder, "events"), "event_type")


# 80 percent of the range of the first eight hexadecimal digits ends at cccccccd.
@register(
    "hash_split",
    "SELECT event_id, md5('42:' || CAST(event_id AS VARCHAR)) < 'cccccccd' AS is_train FROM events",
)
def _(spark, folder):
    return op.hash_split(read_table(spark, folder, "events").select("event_id"), ["event_id"])


@register(
    "split_sizes",
    f"""WITH {FEATURES_SQL} SELECT md5('42:' || CAST(event_id AS VARCHAR)) < 'cccccccd' AS is_train, count(*) AS n
    FROM featured GROUP BY 1""",
)
def _(spark, folder):
    frame = op.training_frame(featured_trips(spark, folder), ids=["event_id"])
    return op.distribution(op.hash_split(frame, ["event_id"]), "is_train")


def with_hour_mean(featured: DataFrame) -> DataFrame:
    """Predict each fare by the mean of its hour. The joined table has at most 24 rows."""
    means = featured.groupBy("pickup_hour").agg(F.avg("fare_amount").alias("prediction"))
    return featured.join(F.broadcast(means), "pickup_hour")


METRICS_SQL = (
    f"count(*) AS n, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r('avg(abs(y - p))')} AS mae, "
    f"{r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2 FROM predicted"
)


@register("regression_metrics", f"WITH {HOUR_MEANS_SQL} SELECT {METRICS_SQL}")
def _(spark, folder):
    return rounded(op.regression_metrics(with_hour_mean(featured_trips(spark, folder)), "fare_amount"), "rmse", "mae", "r2")


@register(
    "residual_anomalies",
    f"""WITH {HOUR_MEANS_SQL}
    SELECT event_id, y AS fare_amount, {r('p')} AS prediction FROM predicted
    WHERE abs(y - p) > 2 * (SELECT stddev_samp(y - p) FROM predicted)""",
)
def _(spark, folder):
    predicted = with_hour_mean(featured_trips(spark, folder)).select("event_id", "fare_amount", "prediction")
    return rounded(op.residual_anomalies(predicted, "fare_amount", k=2.0), "prediction")


# A label that the inputs determine, so that there is something to learn: the fares of the test
# tables are noise.
SIGNAL = "fare_signal"
SIGNAL_SQL = f"""{FEATURES_SQL},
signal AS (
  SELECT event_id, 3 + 2.5::DOUBLE * trip_distance + 0.5::DOUBLE * trip_duration_min AS fare_signal,
         md5('42:' || CAST(event_id AS VARCHAR)) < 'cccccccd' AS is_train
  FROM featured)"""


def signal_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    label = 3 + F.lit(2.5) * F.col("trip_distance") + F.lit(0.5) * F.col("trip_duration_min")
    rows = featured_trips(spark, folder).withColumn(SIGNAL, label)
    return op.split_by_id(op.training_frame(rows, label=SIGNAL, ids=["event_id"]), ["event_id"])


def checked(scored: DataFrame, model, features: list[str], depth: int) -> DataFrame:
    """Whether each prediction is the one that the fitted trees, read back as a table, give."""
    walked = op.predict_from_table(scored, op.tree_table(model), features, depth, "walked")
    return walked.withColumn("agrees", F.abs(F.col("walked") - F.col("prediction")) <= 1e-9 * F.abs("prediction"))


def coded_days(scored: DataFrame, model) -> tuple[DataFrame, list[str]]:
    """Scored fares with the index of the weekday that the model has learned, and its inputs in order."""
    labels = model.stages[0].labels
    index = F.coalesce(F.array_position(F.array(*map(F.lit, labels)), F.col("day_of_week")) - 1, F.lit(len(labels)))
    inputs = [f"{name}_idx" if name == "day_of_week" else name for name in op.FARE_FEATURES]
    return scored.withColumn("day_of_week_idx", index.cast("double")), inputs


SCORES_SQL = f"WITH {SIGNAL_SQL} SELECT event_id, fare_signal, true AS agrees FROM signal WHERE NOT is_train"


@register("forest_scores", SCORES_SQL)
def _(spark, folder):
    train, test = signal_split(spark, folder)
    model = op.fit_forest(train, label=SIGNAL)
    scored, inputs = coded_days(op.score(model, test), model)
    return checked(scored, model, inputs, 8).select("event_id", SIGNAL, "agrees")


@register("gbt_scores", SCORES_SQL)
def _(spark, folder):
    train, test = signal_split(spark, folder)
    model = op.fit_gbt(train, label=SIGNAL)
    scored, inputs = coded_days(op.score(model, test), model)
    return checked(scored, model, inputs, 6).select("event_id", SIGNAL, "agrees")


@register(
    "gbt_stop",
    f"WITH {SIGNAL_SQL} SELECT count(*) AS n, true AS fewer, true AS as_good FROM signal WHERE NOT is_train",
)
def _(spark, folder):
    # Part of this label is noise: rounds end when the judging rows gain no more, long before 40.
    noise = 10 * F.pmod(F.col("event_id") * 7919, F.lit(13))
    train, test = (part.withColumn("noisy", F.col(SIGNAL) + noise) for part in signal_split(spark, folder))
    stopped = op.fit_gbt(train, op.BoostSpec(iterations=40, depth=4, validation=20), label="noisy")
    full = op.fit_gbt(train, op.BoostSpec(iterations=40, depth=4), label="noisy")
    both = op.score(full, op.score(stopped, test, "by_stopped"), "by_full")
    compared = op.compare_models(both, "noisy", {"stopped": "by_stopped", "full": "by_full"})
    wide = compared.groupBy("n").pivot("model", ["stopped", "full"]).agg(F.first("rmse"))
    fewer = len(stopped.stages[-1].trees) < len(full.stages[-1].trees)
    return wide.select("n", F.lit(fewer).alias("fewer"), (F.col("stopped") < 1.1 * F.col("full")).alias("as_good"))


@register(
    "feature_importances",
    "SELECT * FROM (VALUES ('trip_distance', true, 1.0::DOUBLE), ('passenger_count', false, 1.0::DOUBLE), "
    "('trip_duration_min', false, 1.0::DOUBLE), ('pickup_hour', false, 1.0::DOUBLE), "
    "('day_of_week_idx', false, 1.0::DOUBLE)) AS t(feature, is_top, total)",
)
def _(spark, folder):
    train, _test = signal_split(spark, folder)
    # Five rows: one per input.
    found = op.feature_importances(op.fit_forest(train, label=SIGNAL))
    whole = Window.partitionBy()
    return found.select(
        "feature",
        (F.col("importance") == F.max("importance").over(whole)).alias("is_top"),
        F.round(F.sum("importance").over(whole), 1).alias("total"),
    )


@register(
    "compare_models",
    f"WITH {SIGNAL_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{model}' AS model, count(*) AS n, true AS learned FROM signal WHERE NOT is_train"
        for model in ("forest", "gbt")
    ),
)
def _(spark, folder):
    train, test = signal_split(spark, folder)
    with op.cached(train.drop("event_id")) as kept:
        forest = op.fit_forest(kept, label=SIGNAL, cache=False)
        boosted = op.fit_gbt(kept, label=SIGNAL, cache=False)
    both = op.score(boosted, op.score(forest, test, "by_forest"), "by_gbt")
    compared = op.compare_models(both, SIGNAL, {"forest": "by_forest", "gbt": "by_gbt"})
    return compared.select("model", "n", (F.col("r2") > 0.9).alias("learned"))


@register(
    "demand_forest",
    """WITH cells AS (
      SELECT event_type, CAST(hour(ts) AS INTEGER) AS pickup_hour, strftime(ts, '%a') AS day_of_week,
             count(*) AS trip_count
      FROM events GROUP BY 1, 2, 3)
    SELECT event_type, pickup_hour, day_of_week, trip_count, true AS agrees FROM cells
    WHERE md5('42:' || event_type || ':' || pickup_hour || ':' || day_of_week) >= 'cccccccd'""",
)
def _(spark, folder):
    events = read_table(spark, folder, "events")
    model, scored = op.fit_demand(events, key="event_type", ts="ts", fill=False)
    coded, _ = coded_days(model.codes.add(scored, "event_type_code"), model)
    inputs = ["event_type_code", "pickup_hour", "day_of_week_idx", "is_weekend"]
    return checked(coded, model.pipeline, inputs, 5).select(
        "event_type", "pickup_hour", "day_of_week", "trip_count", "agrees"
    )


PANEL_SQL = """days AS (
      SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS day FROM events),
    counts AS (
      SELECT event_type, CAST(ts AS DATE) AS day, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3),
    panel AS (
      SELECT event_type, CAST(CAST(day AS DATE) AS VARCHAR) AS date, CAST(h AS INTEGER) AS pickup_hour,
             strftime(day, '%a') AS day_of_week, CAST(dayofweek(day) IN (0, 6) AS INTEGER) AS is_weekend,
             coalesce(n, 0) AS n
      FROM (SELECT * FROM (SELECT DISTINCT event_type FROM events), days, range(24) AS hours(h))
      LEFT JOIN counts USING (event_type, day, h))"""


@register("demand_panel", f"WITH {PANEL_SQL} SELECT * FROM panel")
def _(spark, folder):
    panel = op.demand_panel(read_table(spark, folder, "events"), "event_type", "ts")
    return panel.withColumn("date", F.col("date").cast("string"))


@register(
    "demand_model",
    f"""WITH {PANEL_SQL}, span AS (SELECT min(date)::DATE AS first, max(date)::DATE AS last FROM panel)
    SELECT count(*) AS n, sum(n)::BIGINT AS trips, true AS beats_cell_mean FROM panel, span
    WHERE date::DATE >= first + CAST((last - first + 1) * 80 // 100 AS INTEGER)""",
)
def _(spark, folder):
    # The forest against the mean of the cell (key, hour, weekday) over the earlier days.
    events = read_table(spark, folder, "events")
    _model, scored = op.fit_demand(events, key="event_type", ts="ts")
    earlier, _later = op.time_split(op.demand_panel(events, "event_type", "ts", count_as="trip_count"))
    cell = ["event_type", "pickup_hour", "day_of_week"]
    both = op.cell_means(earlier, scored, cell, "trip_count", "by_cell")
    compared = op.compare_models(both, "trip_count", {"forest": "prediction", "cell": "by_cell"})
    errors = compared.groupBy().pivot("model", ["forest", "cell"]).agg(F.first("rmse"))
    better = errors.select(F.col("forest") < F.col("cell")).scalar()
    return scored.agg(F.count(F.lit(1)).alias("n"), F.sum("trip_count").alias("trips")).withColumn("beats_cell_mean", better)


@register(
    "category_codes",
    f"""WITH per_key AS (SELECT user_id, count(*) AS n, sum({cents_sql('value')}) AS total FROM events GROUP BY 1)
    SELECT user_id, n, round((total + 10.0::DOUBLE * (SELECT sum(total)::DOUBLE / sum(n) FROM per_key)) / (n + 10), 4) AS code
    FROM per_key""",
)
def _(spark, folder):
    rows = exact(read_table(spark, folder, "events"), "value")
    return rounded(op.category_codes(rows, "user_id", "value").table, "code")


@register(
    "exact_split",
    """SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%a') ORDER BY md5('42:' || CAST(event_id AS VARCHAR)))
      <= (count(*) OVER (PARTITION BY strftime(ts, '%a')) * 80 + 50) // 100 AS is_train FROM events""",
)
def _(spark, folder):
    events = read_table(spark, folder, "events")
    return op.exact_split(events, ["event_id"], by=F.dayname("ts")).select("event_id", "is_train")


# A third of the rows have one key and a twentieth another one.
SKEWED_SQL = """skewed AS (
      SELECT CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 20 = 1 THEN -2 ELSE user_id END AS k FROM events)"""


def skewed_events(spark: SparkSession, folder: str) -> DataFrame:
    item = F.col("event_id")
    key = F.when(item % 3 == 0, -1).when(item % 20 == 1, -2).otherwise(F.col("user_id"))
    return read_table(spark, folder, "events").select("event_id", "value", key.alias("k"))


@register(
    "hot_keys",
    f"""WITH {SKEWED_SQL} SELECT k, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM skewed), 4) AS share
    FROM skewed GROUP BY k HAVING count(*) >= 0.03 * (SELECT count(*) FROM skewed)""",
)
def _(spark, folder):
    return rounded(op.hot_keys(skewed_events(spark, folder), "k", 0.03), "share")


@register(
    "relayout_skewed_avg", f"WITH {SKEWED_SQL.replace(' AS k ', ' AS k, value ')} SELECT k, {avg_sql('value')} AS avg_value FROM skewed GROUP BY k"
)
def _(spark, folder):
    spread = op.relayout_skewed(exact(skewed_events(spark, folder), "value"), LAYOUT_PARTITIONS, "k", ["event_id"])
    return amounts(op.avg_by_key(spread, "k", "value"), "avg_value")


@register(
    "parity_changed",
    """SELECT event_id, user_id, event_type, value + 1 AS value, CAST(-1 AS BIGINT) AS surplus FROM events WHERE event_id = 7
    UNION ALL SELECT event_id, user_id, event_type, value, CAST(1 AS BIGINT) FROM events WHERE event_id = 7""",
)
def _(spark, folder):
    rows = read_table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    changed = rows.withColumn("value", F.when(F.col("event_id") == 7, F.col("value") + 1).otherwise(F.col("value")))
    return op.differences(rows, changed)


# The trips once more, a month later, in a table stored by month whose second month is then renewed.
STORED_SQL = f"""{TRIPS_SQL}, stored AS (
      SELECT event_id, fare_amount, "PULocationID", strftime(tpep_pickup_datetime, '%Y-%m') AS month FROM trips
      UNION ALL
      SELECT event_id, fare_amount, "PULocationID", strftime(tpep_pickup_datetime + INTERVAL 31 DAY, '%Y-%m') FROM trips
      WHERE fare_amount > 0)"""


def two_months(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    first = trips(spark, folder, distance=False).select("event_id", PICKUP, "fare_amount", "PULocationID")
    return first, first.withColumn(PICKUP, F.col(PICKUP) + F.expr("INTERVAL 31 DAYS"))


@register(
    "stored_months",
    f"WITH {STORED_SQL} SELECT month, count(*) AS n, {avg_sql('fare_amount')} AS avg_fare FROM stored GROUP BY 1",
)
def _(spark, folder):
    first, second = two_months(spark, folder)
    path = f"{op.ensure_checkpoint_dir(spark)}/months-{uuid.uuid4()}"
    store_months(union_months([first, second]), path)
    months = [r["month"] for r in op.distribution(read_stored_months(spark, path), "month").collect()]
    store_months(second.where("fare_amount > 0"), path)
    stored = read_stored_months(spark, path, months[0], months[-1])
    per_month = exact(stored, "fare_amount").groupBy("month")
    return amounts(per_month.agg(F.count(F.lit(1)).alias("n"), F.avg("fare_amount").alias("avg_fare")), "avg_fare")


def stored_state(spark: SparkSession, folder: str) -> DataFrame:
    """Moments of both months by place, each month stored on its own."""
    path = f"{op.ensure_checkpoint_dir(spark)}/moments-{uuid.uuid4()}"
    first, second = two_months(spark, folder)
    for month in (first, second.where("fare_amount > 0")):
        store_months(op.month_moments(exact(month, "fare_amount"), PICKUP, "PULocationID", ["fare_amount"]), path)
    return read_stored_months(spark, path)


@register("avg_by_key_state", f"""WITH {STORED_SQL} SELECT "PULocationID", {avg_sql('fare_amount')} AS avg_fare FROM stored GROUP BY 1""")
def _(spark, folder):
    state = stored_state(spark, folder)
    return amounts(op.avg_by_key_state(state, "PULocationID", "fare_amount", "avg_fare"), "avg_fare")


@register("summarize_state", summary_sql("stored", ["fare_amount"], f"WITH {STORED_SQL} "))
def _(spark, folder):
    return rounded(amounts(op.summarize_state(stored_state(spark, folder)), *SUMMARY), "stddev")


@register(
    "outlier_groups_state",
    f"""WITH {STORED_SQL}
    SELECT "PULocationID", {avg_sql('fare_amount')} AS avg_fare, count(*) AS n FROM stored
    GROUP BY 1
    HAVING avg(fare_amount) > (SELECT avg(fare_amount) + 2 * stddev_samp(fare_amount) FROM stored)""",
)
def _(spark, folder):
    state = stored_state(spark, folder)
    return amounts(op.outlier_groups_state(state, "PULocationID", "fare_amount", avg_as="avg_fare"), "avg_fare")


@register(
    "demand_table_filled",
    """WITH keys AS (SELECT DISTINCT event_type FROM events),
    cells AS (
      SELECT event_type, CAST(h AS INTEGER) AS pickup_hour, d AS day_of_week
      FROM keys, range(24) AS hours(h), (SELECT unnest(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun']) AS d)),
    counts AS (
      SELECT event_type, CAST(hour(ts) AS INTEGER) AS pickup_hour, strftime(ts, '%a') AS day_of_week, count(*) AS n
      FROM events GROUP BY 1, 2, 3),
    days AS (SELECT strftime(ts, '%a') AS day_of_week, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1)
    SELECT event_type, pickup_hour, day_of_week, CAST(day_of_week IN ('Sat', 'Sun') AS INTEGER) AS is_weekend,
           coalesce(n, 0) AS n, coalesce(days, 0) AS days,
           CASE WHEN days > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / days END AS per_day
    FROM cells LEFT JOIN counts USING (event_type, pickup_hour, day_of_week) LEFT JOIN days USING (day_of_week)""",
)
def _(spark, folder):
    return op.demand_table_filled(read_table(spark, folder, "events"), "event_type", "ts")
