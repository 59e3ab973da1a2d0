"""Landed files are compressed and come in pieces, and a load leaves no shuffle files behind."""

import math
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

import lake_queries
from wardlake.plans.silver import PBJ_KEYS
from wardlake.session import shuffles_cleaned, written
from wardlake.sources import sample
from wardlake.sources.bronze import SOURCE_PATH, read_bronze_pbj

SF_DIR = "/root/testdata/sf0.001"
SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return manager.getAllFiles().mkString("\n").count("shuffle_")


def settles(spark, most):
    for _ in range(50):  # Spark deletes them in the background
        if shuffle_files(spark) <= most:
            return True
        time.sleep(0.1)
    return False


def counted(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("copies", [1, 2])
def test_landed_days_are_the_raw_rows(spark, tmp_path, monkeypatch, copies):
    monkeypatch.setattr(sample, "FILE_ROWS", 700)
    raw = sample.bronze_pbj(spark, SF_DIR, True)
    whole = raw if copies == 1 else raw.unionByName(raw)
    sample.land_pbj(sample.daily_fact(spark, SF_DIR), str(tmp_path), True, *PBJ_KEYS, copies=copies)
    files = [name for name in os.listdir(tmp_path) if name.startswith("part-")]
    assert len(files) == math.ceil(whole.count() / 700) > 1 and all(name.endswith(".csv.gz") for name in files)
    stored = read_bronze_pbj(spark, str(tmp_path))
    # Blank cells are read as NULL.
    rendered = whole.select(*(F.nullif(F.col(name), F.lit("")).alias(name) for name in whole.columns))
    assert counted(stored.drop(SOURCE_PATH)) == counted(rendered)
    keys = stored.where("WorkDate != 'not a date'").groupBy("PROVNUM", "WorkDate").agg(
        F.count("*").alias("n"), F.count_distinct(SOURCE_PATH).alias("files")
    )
    assert keys.where(f"n != {copies} OR files != 1").count() == 0


def test_followed_files_in_pieces(spark, monkeypatch):
    """The same rows and ledger, from more files than the three that small tables give."""
    query = lake_queries.follow_events_query
    whole, landed = counted(query(spark, SF_DIR)), []
    monkeypatch.setattr(sample, "FILE_ROWS", 700)
    raw = sample.write_raw
    monkeypatch.setattr(sample, "write_raw", lambda df, *rest: landed.append(df.rdd.getNumPartitions()) or raw(df, *rest))
    assert counted(query(spark, SF_DIR)) == whole
    assert max(landed) > lake_queries.PIECES and all(n % lake_queries.PIECES == 0 for n in landed)


def test_writes_delete_their_shuffle_files(spark, tmp_path):
    shuffled = spark.range(1000).repartition(3).groupBy("id").count()
    before = shuffle_files(spark)
    kept = written(shuffled, "kept")
    sample.write_raw(shuffled.select(F.col("id").cast("string")), str(tmp_path / "raw"))
    lake_queries._lake(spark).numbers.append(lambda known: shuffled.select(
        F.col("id").cast("string").alias("ccn"), F.col("id").alias("number")
    ))
    assert settles(spark, before) and kept.count() == 1000


def test_overlapping_blocks_leave_the_setting(spark):
    before, inside, left = spark.conf.get(SETTING), threading.Event(), threading.Event()

    def other():
        with shuffles_cleaned(spark):
            inside.set()
            left.wait(20)

    thread = threading.Thread(target=other)
    with shuffles_cleaned(spark):
        thread.start()
        inside.wait(20)
    assert spark.conf.get(SETTING) == "true"
    left.set()
    thread.join()
    assert spark.conf.get(SETTING) == before
