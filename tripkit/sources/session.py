"""Session settings for tests, benchmarks and examples.

On a cluster the submitted configuration decides; nothing in the operators depends on it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(
    app: str = "tripkit",
    shuffle_partitions: int = 8,
    master: str | None = None,
    driver_memory: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Start (or get) a session with few shuffle partitions and a UTC clock."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Plans are built from many small expressions; recording a call site for each costs time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
