"""The SQL surface: SQL text over a passed DataFrame, with column names and values as parameters.

Frames are passed by reference, so no global view name is claimed, and values travel as
query parameters, so nothing is spliced into the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripkit.operators.layout import checkpointed


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql(df: DataFrame, text: str, values: dict | None = None, **names: str) -> DataFrame:
    args = {key: _quoted(name) for key, name in names.items()} | (values or {})
    return df.sparkSession.sql(text, args=args, t=df)


def sql_avgs_by_key(
    df: DataFrame, key: str, first: str, second: str, first_as: str, second_as: str
) -> DataFrame:
    """Two averages per key, in key order."""
    return _sql(
        df,
        """
        SELECT IDENTIFIER(:key),
               avg(IDENTIFIER(:first)) AS IDENTIFIER(:first_as),
               avg(IDENTIFIER(:second)) AS IDENTIFIER(:second_as)
        FROM {t}
        GROUP BY IDENTIFIER(:key)
        ORDER BY IDENTIFIER(:key) NULLS FIRST
        """,
        key=key,
        first=first,
        second=second,
        first_as=first_as,
        second_as=second_as,
    )


def sql_topk_by_count(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """SQL twin of ``topk_by_count``."""
    return _sql(
        df,
        """
        SELECT IDENTIFIER(:key), count(*) AS n
        FROM {t}
        GROUP BY IDENTIFIER(:key)
        ORDER BY n DESC, IDENTIFIER(:key) NULLS LAST
        LIMIT :k
        """,
        {"k": k},
        key=key,
    )


def sql_topk_by_sum(df: DataFrame, key: str, measure: str, k: int = 10, sum_as: str = "total") -> DataFrame:
    """SQL twin of ``topk_by_sum``."""
    return _sql(
        df,
        """
        SELECT IDENTIFIER(:key), sum(IDENTIFIER(:measure)) AS IDENTIFIER(:sum_as)
        FROM {t}
        GROUP BY IDENTIFIER(:key)
        ORDER BY sum(IDENTIFIER(:measure)) DESC NULLS LAST, IDENTIFIER(:key) NULLS LAST
        LIMIT :k
        """,
        {"k": k},
        key=key,
        measure=measure,
        sum_as=sum_as,
    )


def sql_count_by_hour(df: DataFrame, ts: str) -> DataFrame:
    """SQL twin of ``count_by_hour``."""
    return _sql(
        df,
        """
        SELECT hour(IDENTIFIER(:ts)) AS pickup_hour, count(*) AS n
        FROM {t}
        GROUP BY hour(IDENTIFIER(:ts))
        ORDER BY n DESC, pickup_hour
        """,
        ts=ts,
    )


def sql_avg_by_hour(df: DataFrame, ts: str, measure: str, avg_as: str | None = None) -> DataFrame:
    """SQL twin of ``avg_by_hour``, in hour order."""
    return _sql(
        df,
        """
        SELECT hour(IDENTIFIER(:ts)) AS pickup_hour, avg(IDENTIFIER(:measure)) AS IDENTIFIER(:avg_as)
        FROM {t}
        GROUP BY hour(IDENTIFIER(:ts))
        ORDER BY pickup_hour
        """,
        ts=ts,
        measure=measure,
        avg_as=avg_as or f"avg_{measure}",
    )


def having_avg_gt(
    df: DataFrame, key: str, measure: str, threshold: float, avg_as: str | None = None
) -> DataFrame:
    """``(key, avg, n)`` of the groups whose average exceeds ``threshold``, highest first."""
    return _sql(
        df,
        """
        SELECT IDENTIFIER(:key), avg(IDENTIFIER(:measure)) AS IDENTIFIER(:avg_as), count(*) AS n
        FROM {t}
        GROUP BY IDENTIFIER(:key)
        HAVING avg(IDENTIFIER(:measure)) > :threshold
        ORDER BY avg(IDENTIFIER(:measure)) DESC, IDENTIFIER(:key)
        """,
        {"threshold": float(threshold)},
        key=key,
        measure=measure,
        avg_as=avg_as or f"avg_{measure}",
    )


def outlier_groups(
    df: DataFrame, key: str, measure: str, k: float = 2.0, avg_as: str | None = None
) -> DataFrame:
    """``(key, avg, n)`` of the groups whose mean exceeds mean + ``k`` sample deviations of all rows.

    The table is read and grouped once, when this is called, and the groups are checkpointed:
    as one statement it would be read three times, since each reference to the groups wants
    other columns and so a shuffle of its own. Mean and deviation of all rows follow from the
    groups' counts, means and variances. NaN counts as unknown in all comparisons; the
    reported average is the plain one, NaN where a group has any.
    """
    per_key = checkpointed(
        _sql(
            df,
            """
            SELECT group_key, count(*) AS n, count(x) AS known, avg(x) AS mean, var_pop(x) AS variance,
                   avg(measure) AS shown
            FROM (SELECT IDENTIFIER(:key) AS group_key, IDENTIFIER(:measure) AS measure,
                         CASE WHEN NOT isnan(CAST(IDENTIFIER(:measure) AS DOUBLE)) THEN IDENTIFIER(:measure) END AS x
                  FROM {t})
            GROUP BY group_key
            """,
            key=key,
            measure=measure,
        )
    )
    return _sql(
        per_key,
        """
        WITH overall AS (
          SELECT sum(known) AS known, try_divide(sum(known * CAST(mean AS DOUBLE)), sum(known)) AS mean
          FROM {t}
        ),
        deviation AS (
          SELECT sqrt(try_divide(
                   sum(known * (variance + pow(mean - (SELECT mean FROM overall), 2))),
                   (SELECT known - 1 FROM overall))) AS stddev
          FROM {t}
        )
        SELECT group_key AS IDENTIFIER(:key), shown AS IDENTIFIER(:avg_as), n
        FROM {t}
        WHERE mean > (SELECT mean FROM overall) + :k * (SELECT stddev FROM deviation)
        ORDER BY mean DESC, group_key
        """,
        {"k": float(k)},
        key=key,
        avg_as=avg_as or f"avg_{measure}",
    )
