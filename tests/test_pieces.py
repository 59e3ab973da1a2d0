"""Large raw files are written in pieces, by several tasks, with the same rows and results."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wardlake.sources import sample
from wardlake.sources.bronze import SOURCE_PATH, read_bronze_pbj

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def pieces(monkeypatch):
    monkeypatch.setattr(sample, "FILE_ROWS", 700, raising=False)


def counted(df):
    return sorted(map(str, df.collect()))


def test_pieces_hold_all_rows_of_their_keys(spark, tmp_path, pieces):
    raw = sample.bronze_pbj(spark, SF_DIR)
    sample.write_files(raw.unionByName(raw), str(tmp_path), "PROVNUM", "WorkDate")
    stored = read_bronze_pbj(spark, str(tmp_path))
    assert stored.select(SOURCE_PATH).distinct().count() == -(-2 * raw.count() // 700) > 1
    keys = stored.groupBy("PROVNUM", "WorkDate").agg(F.count("*").alias("n"), F.count_distinct(SOURCE_PATH).alias("files"))
    assert keys.where("n % 2 != 0 OR files != 1").count() == 0 and stored.count() == 2 * raw.count()


def test_one_file_in_pieces(spark, monkeypatch):
    whole = counted(entry._silver_pbj_one_file(spark, SF_DIR))
    monkeypatch.setattr(sample, "FILE_ROWS", 700)
    assert counted(entry._silver_pbj_one_file(spark, SF_DIR)) == whole


def test_files_in_pieces_are_counted_once(spark, pieces):
    assert counted(entry._stream_ledger(spark, SF_DIR)) == [
        "Row(dataset='pbj', status='DONE', files=3)", "Row(dataset='pbj', status='PENDING', files=1)",
        "Row(dataset='providerinfo', status='DONE', files=2)",
    ]
