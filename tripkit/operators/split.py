"""Splits of exact size, by distributed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripkit.functions import free_name, hash_text
from tripkit.operators.encoding import by_size
from tripkit.operators.layout import checkpointed

# Hexadecimal digits by which a round refines: 4,096 bins a stratum.
DIGITS = 3
# Digits of the whole hash.
ALL_DIGITS = 32


def _cutoffs(slim: DataFrame, pct: int) -> DataFrame:
    """``(stratum, cutoff, whole)``: the hash prefix up to which a stratum's rows are chosen, itself if ``whole``.

    A round counts the rows of each bin of the hash's next digits, and goes on inside the bin
    that holds the wanted row: all rows first, then the rows of one bin of 4,096, and so on. What
    is shuffled are bin counts. Strata whose bin fits exactly are done.
    """
    of = Window.partitionBy("stratum")
    until, digits, done = of.orderBy("bin"), DIGITS, None
    bins = slim.groupBy("stratum", F.substring("mark", 1, digits).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = bins.withColumn("need", F.floor((F.sum("n").over(of) * pct + 50) / 100).cast("long"))
    while True:
        before = F.sum("n").over(until) - F.col("n")
        placed = bins.withColumn("before", before).withColumn("rest", F.col("need") - F.col("before"))
        here = F.col("rest").between(1, F.col("n")) | ((F.col("need") == 0) & (F.col("before") == 0))
        found = checkpointed(placed.where(here))
        # At the last digit rows have one hash (one id): they stay together, on the nearer side.
        fits = F.col("rest").isin(0, F.col("n")) | F.lit(digits >= ALL_DIGITS)
        whole = (F.col("rest") > 0) & (2 * F.col("rest") >= F.col("n"))
        ends = found.where(fits).select("stratum", F.col("bin").alias("cutoff"), whole.alias("whole"))
        done = ends if done is None else done.unionAll(ends)
        left = found.where(~fits).select(F.col("stratum").alias("of"), F.col("bin").alias("within"), F.col("rest").alias("need"))
        if left.isEmpty():
            return checkpointed(done)
        digits = min(digits + DIGITS, ALL_DIGITS)
        inside = F.col("stratum").eqNullSafe(F.col("of")) & F.col("mark").startswith(F.col("within"))
        bins = (
            slim.join(by_size(left), inside)
            .groupBy("stratum", "need", F.substring("mark", 1, digits).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
        )


def exact_split(
    df: DataFrame,
    id_cols: Sequence[str],
    pct: int = 80,
    by: str | Column | None = None,
    seed: int = 42,
    out: str = "is_train",
) -> DataFrame:
    """Add a flag that is true for exactly ``pct`` percent of the rows of each stratum, rounded half up.

    ``by`` names the strata (a NULL is one); without it the whole table is one. The rows
    with the smallest hashes of id and seed are chosen, so the split is the same under any
    layout. Rows that share an id stay on one side, which costs exactness if ids repeat.

    Runs when called. The k-th smallest hash of each stratum is found by refining histograms: no
    sort and no window over rows; two rounds are enough for some 10 million rows a
    stratum, three for 60 billion. The cutoffs, one row per stratum, are joined in by size.
    """
    names = {wish: free_name(wish, df.columns) for wish in ("stratum", "mark", "of", "cutoff", "whole")}
    stratum = F.lit(0) if by is None else (F.col(by) if isinstance(by, str) else by)
    mark = hash_text(*id_cols, seed=seed)
    found = _cutoffs(df.select(stratum.alias("stratum"), mark.alias("mark")), pct)
    cutoffs = by_size(found.select(*[F.col(c).alias(names[n]) for n, c in (("of", "stratum"), ("cutoff", "cutoff"), ("whole", "whole"))]))
    marked = df.select("*", stratum.alias(names["stratum"]), mark.alias(names["mark"]))
    joined = marked.join(cutoffs, F.col(names["stratum"]).eqNullSafe(F.col(names["of"])), "left")
    cutoff = F.col(names["cutoff"])
    prefix = F.substring(F.col(names["mark"]), F.lit(1), F.length(cutoff))
    chosen = (prefix < cutoff) | ((prefix == cutoff) & F.col(names["whole"]))
    return joined.select(*[joined[f"`{c}`"] for c in df.columns], F.coalesce(chosen, F.lit(False)).alias(out))
