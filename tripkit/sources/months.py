"""Tables stored by month: adding or renewing a month touches one folder, reading some opens only theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the partition column, with values like 2024-01.
MONTH = "month"


def store_months(df: DataFrame, path: str, ts: str = "tpep_pickup_datetime") -> None:
    """Write ``df`` to the table at ``path``, replacing exactly the months that it holds.

    Other months stay as they are (dynamic partition overwrite). The month is that of ``ts``, or an own column
    ``month`` (text) if there is no ``ts`` among the columns, as in stored moments; a NULL goes to
    a folder of its own. Rows are rebalanced by month first, so a month becomes a few
    files of the advisory size, however many tasks hold its rows and however large it is.
    """
    if ts in df.columns:
        if MONTH in df.columns:
            raise ValueError(f"a column named {MONTH} is in the way")
        df = df.withColumn(MONTH, F.date_format(ts, "yyyy-MM"))
    written = df.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written.partitionBy(MONTH).parquet(path)


def read_stored_months(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored months from ``first`` to ``last`` (``yyyy-MM``, both included; open ends if None).

    The bounds prune folders: files of other months are neither opened nor listed in the scan. Rows without a
    month come only without bounds.
    """
    table = spark.read.parquet(path)
    month = F.col(MONTH).cast("string")
    table = table.withColumn(MONTH, month) if dict(table.dtypes)[MONTH] != "string" else table
    if first is not None:
        table = table.where(F.col(MONTH) >= first)
    if last is not None:
        table = table.where(F.col(MONTH) <= last)
    return table
