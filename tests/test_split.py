import hashlib

import pytest
from pyspark.sql import functions as F

from tests.trips import values
from tripkit import operators as op
from tripkit.operators import split


def share(n, pct):
    return (n * pct + 50) // 100


@pytest.mark.parametrize("pct", [0, 1, 50, 80, 100])
def test_sizes_are_exact_in_every_stratum(spark, pct):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 5).alias("k"), F.lit("x").alias("mark"))
    for rows in (df, df.repartition(13)):
        flagged = op.exact_split(rows, ["id"], pct, by="k")
        assert flagged.columns == [*df.columns, "is_train"]
        sizes = flagged.groupBy("k").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()
        assert len(sizes) == 6 and all(r["t"] == share(r["n"], pct) for r in sizes)
    marks = {i: hashlib.md5(f"42:{i}".encode()).hexdigest() for i in range(5000)}
    first = sorted(marks, key=marks.get)[: share(5000, pct)]
    assert sorted(values(op.exact_split(df, ["id"], pct).where("is_train"), "id")) == sorted(first)


def test_rounds_of_one_digit_find_the_same_rows(spark, monkeypatch):
    df = spark.range(700)
    want = sorted(values(op.exact_split(df, ["id"], 33).where("is_train"), "id"))
    monkeypatch.setattr(split, "DIGITS", 1)
    assert sorted(values(op.exact_split(df, ["id"], 33).where("is_train"), "id")) == want


def test_repeated_ids_stay_together(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(2,)] * 10 + [(None,)] * 10, "id int")
    flagged = op.exact_split(df, ["id"], 50).groupBy("id").agg(F.countDistinct("is_train").alias("sides"), F.count_if("is_train").alias("n"))
    assert {r["sides"] for r in flagged.collect()} == {1}
    assert sum(values(flagged, "n")) in (10, 20)
    assert op.exact_split(df.limit(0), ["id"]).count() == 0
    assert values(op.exact_split(spark.range(1), ["id"], 80), "is_train") == [True]
