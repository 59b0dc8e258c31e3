import gc

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tests.trips import table, trip, values
from tripkit import operators as op
from tripkit.sources import as_view, read_months, read_trips, schema_table, union_months


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of all rows, and all alike but for the id, have one key.
    return spark.range(9000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"), (F.col("id") % 11).alias("v")
    )


@pytest.mark.parametrize("n", [1, 4, 8, 16, 32, 64])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_result_does_not_depend_on_the_layout(skewed, n, keys):
    spread = op.relayout(skewed, n, *keys)
    assert op.partition_count(spread) == n
    op.assert_same(op.avg_by_key(spread, "k", "v"), op.avg_by_key(skewed, "k", "v"))


def test_a_hot_key_is_spread(skewed):
    salted = op.relayout(skewed, 64, "k", spread=["id"]).where("k = 0")
    together = op.relayout(skewed, 64, "k", salts=1).where("k = 0")
    assert op.partition_profile(together).count() == 1
    assert op.partition_profile(salted).count() > 4
    assert max(values(op.partition_profile(salted), "n")) < 1500


def test_a_hot_key_reaches_nearly_all_partitions(skewed):
    n = 48
    sizes = values(op.partition_profile(op.relayout(skewed, n, "k", spread=["id"]).where("k = 0")), "n")
    # 3,000 rows in 48 places fill about two thirds of the partitions twice over or not at all.
    assert len(sizes) > 0.55 * n and max(sizes) < 0.15 * sum(sizes)


def test_without_a_number_spark_rebalances(skewed):
    for keys in ((), ("k",)):
        spread = op.relayout(skewed, None, *keys)
        assert "REBALANCE" in spread._jdf.queryExecution().executedPlan().toString()
        op.assert_same(spread, skewed)


def test_a_held_frame_is_read_by_all_consumers_and_released_with_the_result(skewed):
    kept = op.held(skewed.select("k", "v"))
    result = op.release_with(op.avg_by_key(kept, "k", "v").unionAll(op.avg_by_key(kept, "v", "k")), kept)
    assert result._jdf.queryExecution().executedPlan().toString().count("InMemoryTableScan") >= 2
    result.collect()
    del result
    gc.collect()
    assert not kept.storageLevel.useMemory


def test_ids_spread_rows_without_a_sort(skewed):
    by_id = op.relayout(skewed, 8, spread=["id"])
    counts = values(op.partition_profile(by_id), "n")
    assert len(counts) == 8 and sum(counts) == 9000
    assert max(counts) < 2 * min(counts)


def test_partition_profile_counts_all_rows(skewed):
    assert sum(values(op.partition_profile(skewed.repartition(5)), "n")) == 9000


def test_cache_is_released(skewed):
    with op.cached(skewed) as held:
        assert held.storageLevel.useMemory
        op.assert_same(op.avg_by_key(held, "k", "v"), op.avg_by_key(skewed, "k", "v"))
    assert not skewed.storageLevel.useMemory
    with pytest.raises(RuntimeError), op.cached(skewed):
        raise RuntimeError
    assert not skewed.storageLevel.useMemory


def test_a_cache_of_the_caller_stays(skewed):
    mine = skewed.where("v > 3").persist()
    with op.cached(mine):
        pass
    assert mine.storageLevel.useMemory
    mine.unpersist()


def test_checkpoint_goes_where_the_session_says(spark, skewed):
    folder = op.ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in folder
    kept = op.checkpointed(skewed)
    op.assert_same(kept, skewed)
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_union_by_name(spark):
    first = table(spark, trip(), trip())
    second = table(spark, trip()).select(*reversed(first.columns))
    both = union_months([first, second])
    assert both.columns == first.columns
    assert both.count() == 3
    widened = union_months([first, first.withColumn("passenger_count", F.col("passenger_count").cast("int"))])
    assert dict(widened.dtypes)["passenger_count"] == "bigint"
    with pytest.raises(AnalysisException):
        union_months([first, second.drop("tip_amount")])
    filled = union_months([first, second.drop("tip_amount")], allow_missing=True)
    assert filled.where("tip_amount is null").count() == 1
    with pytest.raises(ValueError):
        union_months([])


def test_months_with_unlike_files(spark, tmp_path):
    january, february = str(tmp_path / "a"), str(tmp_path / "b")
    table(spark, trip()).write.parquet(january)
    table(spark, trip(), trip()).withColumn("passenger_count", F.lit(1.0)).write.parquet(february)
    both = read_months(spark, [january, february])
    assert both.count() == 3
    assert dict(both.dtypes)["passenger_count"] == "double"
    assert read_trips(spark, january, january + "/").count() >= 1


def test_schema_and_view(spark):
    df = as_view(table(spark, trip()), "some_trips")
    assert spark.sql("SELECT count(*) FROM some_trips").first()[0] == 1
    spark.catalog.dropTempView("some_trips")
    listed = values(schema_table(df))
    assert listed[0] == (1, "tpep_pickup_datetime", "timestamp_ntz", True)
    assert [row[1] for row in listed] == df.columns
