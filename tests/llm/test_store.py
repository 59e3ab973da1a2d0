"""Life span of stored tables."""

import os
import time

from wardlake.llm.store import discard, release, scope, stored


def held(df):
    return {os.path.dirname(path).removeprefix("file:").replace("///", "/") for path in df.inputFiles()}


def test_tables_are_released_but_for_those_still_read(spark):
    with scope() as made:
        one, two = stored(spark.range(5), "one"), stored(spark.range(7), "two")
    outside = stored(spark.range(3), "other")
    assert len(made) == 2
    assert release(spark, made, two.where("id > 2")) == [made[1]]
    assert two.count() == 7 and outside.count() == 3
    assert not os.path.exists(made[0].removeprefix("file:")) and one.columns == ["id"]
    assert release(spark, made[1:], outside) == []
    assert not os.path.exists(made[1].removeprefix("file:"))


def test_discarded_tables_are_gone(spark):
    one, two = stored(spark.range(5), "one"), stored(spark.range(0), "none")
    (folder,) = held(one)
    discard(one, two)
    assert not os.path.exists(folder)


def test_shuffle_files_go_with_the_query(spark):
    """What a stored table was shuffled through is deleted, and the setting is as before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    frame = spark.range(1000).repartition(3).groupBy("id").count()
    count = shuffle_count(manager)
    table = stored(frame, "shuffled")
    assert spark.conf.get(key) == before
    for _ in range(50):  # Spark deletes them in the background
        if shuffle_count(manager) <= count:
            break
        time.sleep(0.1)
    assert shuffle_count(manager) <= count
    assert table.count() == 1000


def shuffle_count(manager):
    return manager.getAllFiles().mkString("\n").count("shuffle_")
