import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardlake.operators.upsert import upsert

COLUMNS = "k string, d int, a int, b int"


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.fixture
def target(spark):
    return spark.createDataFrame(
        [("x", 1, 10, 11), ("y", 1, 20, 21), ("z", None, 30, 31)], COLUMNS
    )


@pytest.fixture
def source(spark):
    return spark.createDataFrame(
        [("y", 1, None, 99), ("y", 2, 40, 41), (None, 1, 50, 51)], COLUMNS
    )


def test_overwrite_updates_inserts_and_keeps(target, source):
    assert rows(upsert(target, source, ["k", "d"])) == sorted(
        [("x", 1, 10, 11), ("y", 1, None, 99), ("z", None, 30, 31), ("y", 2, 40, 41),
         (None, 1, 50, 51)], key=str)


def test_null_keys_can_be_rejected(target, source):
    result = rows(upsert(target, source, ["k", "d"], on_null_key="reject"))
    assert (None, 1, 50, 51) not in result
    assert ("z", None, 30, 31) in result


def test_missing_values_keep_the_old_ones(target, source):
    result = rows(upsert(target, source, ["k", "d"], keep_old_when_null=True))
    assert ("y", 1, 20, 99) in result


def test_only_listed_columns_change_on_a_match(target, source):
    result = rows(upsert(target, source, ["k", "d"], update=["b"]))
    assert ("y", 1, 20, 99) in result
    assert ("y", 2, 40, 41) in result


def test_columns_the_source_lacks_are_kept_or_null(target, source):
    result = rows(upsert(target, source.drop("a"), ["k", "d"]))
    assert ("y", 1, 20, 99) in result
    assert ("y", 2, None, 41) in result


def test_twice_is_once(target, source):
    once = upsert(target, source, ["k", "d"], on_null_key="reject")
    twice = upsert(once, source, ["k", "d"], on_null_key="reject")
    assert rows(once) == rows(twice)


def test_null_key_rows_are_inserted_again_by_default(target, source):
    once = upsert(target, source, ["k", "d"])
    assert upsert(once, source, ["k", "d"]).count() == once.count() + 1


def test_duplicate_source_keys_fail_even_when_only_counted(spark, target, source):
    doubled = source.unionByName(source.where("k = 'y' AND d = 2"))
    with pytest.raises(PySparkException, match="more than one source row for key y, 2"):
        upsert(target, doubled, ["k", "d"]).collect()
    with pytest.raises(PySparkException, match="more than one source row"):
        upsert(target, doubled, ["k", "d"]).count()


def test_duplicate_null_keys_do_not_fail(target, source):
    doubled = source.unionByName(source.where("k IS NULL"))
    assert upsert(target, doubled, ["k", "d"]).where("k IS NULL").count() == 2


def test_null_keys_are_dealt_out_and_inputs_read_once(spark, tmp_path):
    # A third of the rows without a key would otherwise meet in one task.
    spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("v")
    ).write.parquet(f"{tmp_path}/source")
    spark.createDataFrame([(1, 1)], "k bigint, v bigint").write.parquet(f"{tmp_path}/target")
    target, source = spark.read.parquet(f"{tmp_path}/target"), spark.read.parquet(f"{tmp_path}/source")
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        result = upsert(target, source, ["k"])
        loose = result.where("k IS NULL").groupBy(F.spark_partition_id().alias("task")).count()
        sizes = [row["count"] for row in loose.collect()]
        assert sum(sizes) == 1000 and max(sizes) < 500
    finally:
        spark.conf.unset(coalesced)
    assert result.count() == 3000
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 4 and "Union" not in plan  # AQE shows the plan twice


def test_unknown_null_policy(target, source):
    with pytest.raises(ValueError):
        upsert(target, source, ["k"], on_null_key="maybe")
