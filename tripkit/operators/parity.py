"""Comparing two results as multisets of rows, whatever their order.

Rows are compared in a tree of hash buckets: a bucket's digest doesn't depend on the order of its
rows, equal digests need no second look, and only the rows of unequal buckets are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripkit.functions import free_name
from tripkit.operators.layout import checkpointed

# Bits of the row hash that name a bucket, level by level.
LEVELS = (6, 14)


def _aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the same columns, in the same order and types."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    common = left.limit(0).unionByName(right.limit(0)).schema
    cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in common.fields]
    return left.select(*cast), right.select(*cast)


def _digests(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """``(bucket, left_rows, right_rows, a, b)`` of the buckets of both sides.

    ``a`` and ``b`` are differences of sums of two row hashes: zero for equal buckets.
    """
    zero = F.lit(0).cast("long")

    def side(df: DataFrame, sign: int) -> DataFrame:
        marks = [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(seed)) for seed in (1, 2)]
        one = F.lit(1).cast("long")
        return df.select(
            F.pmod(marks[0], F.lit(1 << bits)).alias("bucket"),
            *([one.alias("l"), zero.alias("r")] if sign > 0 else [zero.alias("l"), one.alias("r")]),
            *[(mark.cast("decimal(20,0)") * sign).alias(name) for name, mark in zip("ab", marks, strict=True)],
        )

    both = side(left, 1).unionAll(side(right, -1))
    return both.groupBy("bucket").agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )


_UNEQUAL = "left_rows <> right_rows OR a <> 0 OR b <> 0"


def _narrowed(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The digests of the first level, and both sides without the buckets that are equal.

    Each level reads the sides once and shuffles one row per task and bucket; the unequal
    buckets of a level, at most two to the power of its bits, are broadcast to the next.
    """
    first = None
    for bits in LEVELS:
        digests = checkpointed(_digests(left, right, bits))
        first = digests if first is None else first
        unequal = digests.where(_UNEQUAL).select(F.col("bucket").alias(free_name("bucket", left.columns)))
        if unequal.isEmpty():
            return first, left.limit(0), right.limit(0)
        name = unequal.columns[0]

        def kept(df: DataFrame) -> DataFrame:
            bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.lit(1)), F.lit(1 << bits))
            return df.join(F.broadcast(unequal), bucket == F.col(name), "left_semi")

        left, right = kept(left), kept(right)
    return first, left, right


def _tallied(left: DataFrame, right: DataFrame) -> DataFrame:
    names, zero = left.columns, F.lit(0).cast("long")
    # Counting each side first lets the optimizer drop the order that it may come in.
    quoted = [F.col(f"`{c}`") for c in names]
    ours = left.groupBy(*quoted).agg(F.count(F.lit(1)).alias("_left")).withColumn("_right", zero)
    theirs = right.groupBy(*quoted).agg(F.count(F.lit(1)).alias("_right")).withColumn("_left", zero)
    return ours.unionByName(theirs).groupBy(*quoted).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows that occur unequally often, with ``surplus``: times more in ``left`` than in ``right``.

    Runs the digests when called: equal sides move a few rows per task and are then done. Columns
    are matched by name and widened to a common type. Two unequal sets of rows pass as equal
    if two 64-bit hash sums of each agree.
    """
    _, left, right = _narrowed(*_aligned(left, right))
    surplus = F.col("_left") - F.col("_right")
    return _tallied(left, right).where(surplus != 0).select(*[F.col(f"`{c}`") for c in left.columns], surplus.alias("surplus"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_rows, right_rows, differing)``: rows on each side and how many have no partner.

    Runs the digests when called, as ``differences`` does.
    """
    digests, left, right = _narrowed(*_aligned(left, right))
    unlike = _tallied(left, right).agg(F.coalesce(F.sum(F.abs(F.col("_left") - F.col("_right"))), F.lit(0)).alias("differing"))
    return digests.agg(
        F.coalesce(F.sum("left_rows"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_rows"), F.lit(0)).alias("right_rows"),
    ).withColumn("differing", unlike.scalar())


def assert_same(left: DataFrame, right: DataFrame) -> None:
    """Raise an AssertionError that shows some differing rows, if there are any."""
    unequal = differences(left, right).take(5)
    assert not unequal, f"results differ, for example: {unequal}"
