"""Categories with any number of values as inputs of a model: dictionaries joined in by size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripkit.functions import free_name
from tripkit.operators.explore import category_index
from tripkit.operators.layout import checkpointed

# A dictionary of at most so many categories goes to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
# A category's mean counts as if so many rows of the overall mean were among its own.
SMOOTHING = 10.0


def by_size(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it is small; a plain join side beyond that."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def join_dictionary(df: DataFrame, table: DataFrame, column: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the ``value`` that ``table`` has for ``column`` (NULL matches NULL), or NULL.

    ``table`` has one row per category and is stored; it is broadcast if it is small. Beyond
    that Spark splits the rows of a hot category in the shuffle.
    """
    theirs = free_name("their_category", df.columns)
    side = by_size(table.select(F.col(column).alias(theirs), F.col(value).alias(out)))
    return df.join(side, F.col(column).eqNullSafe(F.col(theirs)), "left").drop(theirs)


@dataclass(frozen=True)
class CategoryCodes:
    """Codes of the categories of ``column``: ``table`` has ``(column, n, code)``, ``prior`` is for others."""

    column: str
    table: DataFrame
    prior: float | None

    def add(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the code of each row's category; one that training has not seen gets the prior."""
        coded = join_dictionary(df, self.table, self.column, "code", out)
        return coded.withColumn(out, F.coalesce(out, F.lit(self.prior).cast("double")))


def category_codes(df: DataFrame, column: str, label: str, smoothing: float = SMOOTHING) -> CategoryCodes:
    """Target-mean codes: a category's code is the mean label of its rows, drawn to the overall mean.

    Ordered by such codes, a tree's threshold splits categories in the order of their means, which
    is where the best split of a regression lies. So a column of millions of values is one
    ordinary number. Learn the codes from training rows only. NULL is a category; rows with a
    NULL label don't count. Runs when called: the rows are grouped once, and the driver sees the overall mean.
    """
    known = df.where(F.col(label).isNotNull())
    sums = checkpointed(known.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("total")))
    prior = sums.agg(F.try_divide(F.sum("total"), F.sum("n"))).first()[0]
    code = (F.col("total") + F.lit(smoothing) * F.lit(prior)) / (F.col("n") + F.lit(smoothing))
    return CategoryCodes(column, sums.select(column, "n", code.cast("double").alias("code")), prior)


def with_index(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the index of each category, marked as a category for the tree learners.

    ``index`` comes from ``category_index`` over training rows. Categories it lacks share one
    further number, as NULL does. The learners take 32 numbers at most unless ``maxBins`` is raised.
    """
    size = index.count()
    joined = join_dictionary(df, index, column, "idx", out)
    mark = {"ml_attr": {"type": "nominal", "name": out, "num_vals": size + 1}}
    return joined.withColumn(out, F.coalesce(out, F.lit(float(size))).alias(out, metadata=mark))


def learn_index(df: DataFrame, column: str) -> DataFrame:
    """The stored dictionary for ``with_index``: ``(column, idx)``, most frequent first."""
    return checkpointed(category_index(df, column))
