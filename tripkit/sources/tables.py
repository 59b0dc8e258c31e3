"""Reading trip tables, naming them for SQL, joining months, and the trip-shaped view."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_trips(spark: SparkSession, *paths: str) -> DataFrame:
    """Read Parquet files or folders that share one schema, taken from the file footers."""
    return spark.read.parquet(*paths)


def read_months(spark: SparkSession, paths: Sequence[str], allow_missing: bool = False) -> DataFrame:
    """Read monthly files one by one, so that each may have its own column order and number widths."""
    return union_months([read_trips(spark, path) for path in paths], allow_missing)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet``."""
    return read_trips(spark, f"{folder}/{name}.parquet")


def union_months(months: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Concatenate frames by column name and keep duplicates.

    A column that one month lacks is an error unless ``allow_missing`` fills it with NULL.
    The optimizer flattens the nested unions and pushes filters and pruning into every month.
    """
    if not months:
        raise ValueError("union_months needs at least one month")
    return reduce(lambda all_so_far, month: all_so_far.unionByName(month, allow_missing), months)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` visible to SQL text of its session as ``name``."""
    df.createOrReplaceTempView(name)
    return df


def schema_table(df: DataFrame) -> DataFrame:
    """One row per column of ``df``; reads metadata only."""
    rows = [
        (position, field.name, field.dataType.simpleString(), field.nullable)
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    layout = T.StructType(
        [
            T.StructField("ordinal", T.IntegerType(), False),
            T.StructField("column", T.StringType(), False),
            T.StructField("type", T.StringType(), False),
            T.StructField("nullable", T.BooleanType(), False),
        ]
    )
    return df.sparkSession.createDataFrame(rows, layout)


def trips_from_events(events: DataFrame, distance: bool = True) -> DataFrame:
    """A trip-shaped projection of the ``events`` table.

    It breaks every cleaning rule somewhere, has NULL passenger counts and five expensive
    places, so that the trip operators have something to find. Row-local arithmetic only.

    The distance comes out of a JSON column. As a generator the parse runs once per row, after
    the filters on other columns; a plain function would be repeated by every filter on the
    distance. Pass ``distance=False`` to leave that column out and the JSON unread.
    """
    item = F.col("event_id")
    dear = item % 53 == 0
    stay_minutes = (item % 263).cast("int") - 5
    columns = {
        "event_id": item,
        "tpep_pickup_datetime": F.col("ts"),
        "tpep_dropoff_datetime": F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), stay_minutes, F.lit(0)),
        "passenger_count": F.when(item % 21 != 0, item % 8),
        "trip_distance": F.col("k").cast("int") * F.lit(1.02),
        "fare_amount": F.when(item % 37 == 0, -F.col("value"))
        .when(dear, F.col("value") * 10)
        .otherwise(F.col("value")),
        "PULocationID": F.when(dear, 900 + F.col("user_id") % 5).otherwise(F.col("user_id")).cast("int"),
    }
    if distance:
        events = events.select("*", F.json_tuple("props", "k").alias("k"))
    else:
        del columns["trip_distance"]
    return events.select(*[column.alias(name) for name, column in columns.items()])
