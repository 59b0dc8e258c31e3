import pytest
from pyspark.sql import functions as F

from tests.trips import values
from tripkit import operators as op
from tripkit.operators import encoding

ROWS = [("a", 1.0), ("a", 3.0), ("b", 10.0), (None, 4.0), ("c", None)]


def test_codes_are_means_drawn_to_the_overall_mean(spark):
    df = spark.createDataFrame(ROWS, "k string, y double")
    codes = op.category_codes(df, "k", "y", smoothing=2.0)
    assert codes.prior == 4.5
    assert sorted(values(codes.table), key=str) == [("a", 2, (4 + 9) / 4), ("b", 1, 19 / 3), (None, 1, 13 / 3)]
    coded = dict(values(codes.add(df.unionAll(df.limit(0)), "code"), "k", "code"))
    assert coded["c"] == 4.5 and coded[None] == 13 / 3
    none = op.category_codes(df.limit(0), "k", "y")
    assert none.prior is None and values(none.add(df.limit(1), "code"), "code") == [None]


@pytest.mark.parametrize("most", [0, 100])
def test_dictionaries_are_joined_by_size(spark, monkeypatch, most):
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", most)
    df = spark.createDataFrame([*ROWS, ("z", 1.0)], "k string, their_category double")
    index = op.learn_index(df.where("k <> 'z'"), "k")
    indexed = op.with_index(df, index, "k", "k_idx")
    plan = indexed._jdf.queryExecution().optimizedPlan().toString()
    assert ("broadcast" in plan) == (most > 0)
    assert sorted(values(indexed, "k", "k_idx"), key=str) == [("a", 0.0), ("a", 0.0), ("b", 1.0), ("c", 2.0), ("z", 3.0), (None, 3.0)]
    assert indexed.schema["k_idx"].metadata["ml_attr"]["num_vals"] == 4
    assert indexed.where(F.col("their_category").isNull()).count() == 1
