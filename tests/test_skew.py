from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.trips import values
from tripkit import operators as op


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of the rows have key 0, a tenth no key, and all other keys are distinct.
    i = F.col("id")
    return spark.range(30_000).select("id", F.when(i % 3 == 0, 0).when(i % 10 != 1, i + 100).alias("k"), F.lit(1).alias("salts"))


def test_hot_keys_are_exact_whatever_the_others(skewed):
    n = Counter(values(skewed, "k"))
    found = values(op.hot_keys(skewed, "k", 0.05))
    assert found == [(0, n[0], n[0] / 30_000), (None, n[None], n[None] / 30_000)]
    assert values(op.hot_keys(skewed, "k", 0.2), "k") == [0]
    assert values(op.hot_keys(skewed.limit(0), "k")) == []
    with pytest.raises(ValueError):
        op.hot_keys(skewed, "k", 0.0)
    text = skewed.select(F.concat(F.lit("key "), "k").alias("k"))
    assert values(op.hot_keys(text, "k", 0.2), "k") == ["key 0"]


def test_only_hot_keys_are_split(skewed):
    spread = op.relayout_skewed(skewed, 12, "k", ["id"])
    assert spread.columns == skewed.columns and op.partition_count(spread) == 12
    op.assert_same(spread, skewed)
    places = spread.select("k", F.spark_partition_id().alias("p")).groupBy("k").agg(F.countDistinct("p").alias("parts"))
    parts = dict(values(places.where("k IS NULL OR k = 0"), "k", "parts"))
    assert parts[0] >= 3
    assert values(places.where("k > 0").agg(F.max("parts"))) == [1]
    together = op.relayout(skewed, 12, "k", salts=1)
    assert max(values(op.partition_profile(spread), "n")) < 0.7 * max(values(op.partition_profile(together), "n"))


def test_empty_partitions_appear(skewed):
    few = skewed.where("k = 0").repartition(8, "k")
    assert len(values(op.partition_profile(few))) == 1
    whole = values(op.partition_profile(few, empty=True))
    assert len(whole) == 8 and sorted(n for _, n in whole)[:7] == [0] * 7
