"""Ledger, facility months, bitmaps, streams and catalog of a lake."""

import csv
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from small import beds, day, facility
from test_ingest import CCN, ledger, pbj, providerinfo, worked

from wardlake.operators.selection import Selection
from wardlake.plans import catalog, views
from wardlake.schemas import GOLD_DAILY, GOLD_FACILITY_DIM, GOLD_QUARTERLY
from wardlake.sources.commits import Folder
from wardlake.sources.ledger import FileLedger
from wardlake.streaming.ingest import Lake, follow_events, follow_landing, ingest, retry, run_ingest


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def arrivals(spark, *rows):
    return spark.createDataFrame(
        [("pbj", path, datetime(2024, 4, at)) for path, at in rows], "dataset string, s3_path string, modified timestamp"
    )


def paths(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "s3_path string")


def rows_of(log):
    return sorted((r.s3_path, r.status, r.processed_ts is not None) for r in log.read().collect())


# --- ledger

def test_compaction_changes_no_row(spark, tmp_path):
    log = FileLedger(spark, str(tmp_path))
    log.pending(arrivals(spark, ("a", 1), ("b", 1), ("c", 2)))
    log.done(paths(spark, "a"))
    before = sorted(log.read().collect())
    log.compact()
    assert log.tail() == 0 and sorted(log.read().collect()) == before
    # Known arrivals are known still, finishes reach rows of the snapshot, and later arrivals are new.
    log.pending(arrivals(spark, ("a", 1), ("b", 1), ("a", 3)))
    log.done(paths(spark, "b"))
    expected = [("a", "DONE", True), ("a", "PENDING", False), ("b", "DONE", True), ("c", "PENDING", False)]
    assert rows_of(log) == expected
    assert sorted(r.s3_path for r in log.waiting("pbj").collect()) == ["a", "c"]
    log.compact()
    assert rows_of(log) == expected
    log.compact()
    log.expire(keep=1, seconds=0)
    assert rows_of(log) == expected
    assert len(Folder(spark, f"{tmp_path}/snapshots").names()) == 1
    assert Folder(spark, f"{tmp_path}/entries").names() == []


def test_a_run_reads_pending_rows_and_the_tail_only(spark, tmp_path):
    log = FileLedger(spark, str(tmp_path))
    log.pending(arrivals(spark, ("a", 1), ("b", 2)))
    log.done(paths(spark, "a"))
    log.compact()
    waiting = log.waiting("pbj")
    assert all("status=PENDING" in path for path in waiting.inputFiles() if "/snapshots/" in path) or (
        "PartitionFilters: [isnotnull(status" in plan_of(waiting))
    known = log._known(log.commits.latest()[1], arrivals(spark, ("x", 2)))
    assert "day#" in plan_of(known) and [r.s3_path for r in known.collect()] == ["b"]


def test_entries_added_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    log = FileLedger(spark, str(tmp_path))
    log.pending(arrivals(spark, ("a", 1)))
    inner = FileLedger._log

    def interrupted(self, state, snapshot):
        if not interrupted.done:
            interrupted.done = True
            log.pending(arrivals(spark, ("b", 1)))
            log.done(paths(spark, "a"))
        return inner(self, state, snapshot)

    interrupted.done = False
    monkeypatch.setattr(FileLedger, "_log", interrupted)
    log.compact()
    assert rows_of(log) == [("a", "DONE", True), ("b", "PENDING", False)] and log.tail() == 2


def test_two_writers_log_an_arrival_once(spark, tmp_path, monkeypatch):
    log = FileLedger(spark, str(tmp_path))
    inner = FileLedger._known

    def interrupted(self, state, rows):
        if not interrupted.done:
            interrupted.done = True
            log.pending(arrivals(spark, ("a", 1), ("b", 1)))
        return inner(self, state, rows)

    interrupted.done = False
    monkeypatch.setattr(FileLedger, "_known", interrupted)
    log.pending(arrivals(spark, ("a", 1), ("c", 1)))
    assert [row[0] for row in rows_of(log)] == ["a", "b", "c"]


def test_long_tails_are_compacted_by_the_ingest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("wardlake.streaming.ingest.TAIL", 1)
    lake = Lake(spark, str(tmp_path / "lake"))
    pbj(tmp_path / "landing", "a.csv", worked("1", "2024-04-01", "8"))
    run_ingest(lake, str(tmp_path / "landing"))
    assert lake.ledger.tail() == 0 and ledger(lake) == [("pbj", "a.csv", "DONE")]
    run_ingest(lake, str(tmp_path / "landing"))
    assert ledger(lake) == [("pbj", "a.csv", "DONE")]


# --- facility months and bitmaps

def days(spark, *rows):
    return spark.createDataFrame(list(rows), GOLD_DAILY)


def test_only_changed_months_are_aggregated_again(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.daily.merge(days(spark, day("2024-04-01", "AL", "1", rn=1, residents=5), day("2024-05-01", "AL", "1", rn=2)))
    assert lake.roll_up() == ["2024-04-01", "2024-05-01"]
    folders = lake.months.current()
    lake.daily.merge(days(spark, day("2024-05-02", "GA", "2", rn=4, ctr=1)))
    # Until it is rolled up, a month is aggregated when read.
    whole = sorted(views.facility_months(lake.daily.read()).collect())
    assert sorted(lake.gold().months.collect()) == whole
    assert lake.roll_up() == ["2024-05-01"] and lake.roll_up() == []
    assert lake.months.current()["2024-04-01"] == folders["2024-04-01"]
    assert sorted(lake.months.read().collect()) == whole
    assert sorted(lake.gold().months.collect()) == whole


def test_views_do_not_read_the_fact(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.daily.merge(days(
        spark, day("2024-04-01", "AL", "1", rn=8, lpn=2, residents=10, ctr=3), day("2024-04-02", "AL", "1", cna=5, residents=0),
        day("2024-05-01", "AL", "2", rn=2), day("2024-05-01", None, "3", rn=2, residents=4),
    ))
    lake.quarterly.merge(spark.createDataFrame([beds("1", "AL", 100)], GOLD_QUARTERLY))
    lake.facilities.merge(spark.createDataFrame([facility("1", "Oak", "AL")], GOLD_FACILITY_DIM))
    lake.roll_up()
    stored, computed = lake.gold(), lake.gold()
    computed = views.Gold(computed.daily, computed.quarterly, computed.facilities)
    for view in views.VIEWS.values():
        assert "gold_daily_staffing_fact" not in plan_of(view(stored))
        assert sorted(view(stored).collect(), key=str) == sorted(view(computed).collect(), key=str)
    chosen = Selection(states=["AL"], start=date(2024, 4, 1), end=date(2024, 4, 1))
    for view in views.VIEWS.values():
        assert sorted(view(stored.where(chosen)).collect(), key=str) == sorted(
            view(computed.where(chosen)).collect(), key=str)


def test_distinct_facilities_merge_over_months(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = [day("2024-04-%02d" % (n % 30 + 1), "AL" if n % 3 else "GA", f"c{n}", rn=1) for n in range(40)]
    lake.daily.merge(days(spark, *first))
    lake.roll_up()
    numbers = {r.ccn: r.number for r in lake.numbers.read().collect()}
    assert sorted(numbers.values()) == list(range(40))
    lake.daily.merge(days(spark, day("2024-05-01", "AL", "c1", rn=1), day("2024-05-01", "AL", "new", rn=1),
                          day("2024-06-01", "GA", "c1", rn=1)))
    lake.roll_up()
    # Numbers stay as they were given.
    later = {r.ccn: r.number for r in lake.numbers.read().collect()}
    assert later == numbers | {"new": 40}

    def counts(by, **chosen):
        rows = lake.facility_counts(Selection(**chosen), by).collect()
        return {tuple(row[:-1]): row.facilities for row in rows}

    al = len({row[2] for row in first if row[1] == "AL"})
    assert counts(("state",)) == {("AL",): al + 1, ("GA",): 40 - al + 1}
    assert counts(()) == {(): 41}
    assert counts((), start=date(2024, 5, 1)) == {(): 2}
    assert counts(("month",), states=["AL"], start=date(2024, 5, 1), end=date(2024, 5, 1)) == {(date(2024, 5, 1),): 2}
    plan = plan_of(lake.facility_counts())
    assert "gold_daily" not in plan and "facility_months" not in plan
    with pytest.raises(ValueError, match="bitmaps"):
        lake.facility_counts(Selection(ccns=["c1"]))


def test_numbers_beyond_one_bucket(spark):
    from wardlake.operators.distinct import bitmaps, distinct_count

    cells = spark.range(0, 100_000, 7).select(F.col("id").alias("number"), (F.col("id") % 3).alias("cell"))
    maps = bitmaps(cells.unionByName(cells), ["cell"])
    assert maps.count() > 3
    assert distinct_count(maps, [], "n").first().n == 14286
    assert sum(row.n for row in distinct_count(maps, ["cell"], "n").collect()) == 14286


# --- streams

def message(key):
    return '{"detail": {"bucket": {"name": "b"}, "object": {"key": "%s"}}}' % key


def test_messages_are_followed_over_a_restart(spark, tmp_path):
    landing, told = tmp_path / "landing", tmp_path / "told"
    told.mkdir()
    lake = Lake(spark, str(tmp_path / "lake"))
    stores = {"b": f"file:{landing}"}

    def tell(name, *keys):
        rows = [{"body": message(key), "arrived": "2024-04-01T00:00:00Z"} for key in keys]
        (told / name).write_text("\n".join(map(json.dumps, rows)))

    def follow():
        events = spark.readStream.schema("body string, arrived timestamp").option("maxFilesPerTrigger", 1).json(str(told))
        query = follow_events(lake, events, stores=stores)
        query.awaitTermination()
        return [progress["numInputRows"] for progress in query.recentProgress if progress["numInputRows"]]

    pbj(landing, "a b.csv", worked("1", "2024-04-01", "8"))
    pbj(landing, "b.csv", worked("2", "2024-04-01", "5"))
    providerinfo(landing, "p.csv", {CCN: "1", "provider_name": "Oak", "state": "AL"})
    tell("1.json", "bronze/pbj/a b.csv", "archive/a.csv", "bronze/pbj/a b.csv")
    tell("2.json", "bronze/providerinfo/p.csv")
    assert len(follow()) == 2
    once = ledger(lake)
    assert once == [("pbj", "a b.csv", "DONE"), ("providerinfo", "p.csv", "DONE")]
    # Nothing new: nothing is read again.
    assert follow() == [] and ledger(lake) == once
    pbj(landing, "c.csv", worked("1", "2024-04-01", "9"))
    tell("3.json", "bronze/pbj/b.csv", "bronze/pbj/c.csv")
    assert len(follow()) == 1
    assert {r.ccn: int(r.hrs_rn) for r in lake.daily.read().collect()} == {"000001": 9, "000002": 5}
    assert len(ledger(lake)) == 4


def test_a_batch_that_was_cut_off_is_loaded_again(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    pbj(landing, "a.csv", worked("1", "2024-04-01", "8"))
    providerinfo(landing, "p.csv", {CCN: "1", "state": "AL"})
    inner = Lake.roll_up
    monkeypatch.setattr(Lake, "roll_up", lambda self: 1 / 0)
    with pytest.raises(Exception, match="division by zero"):
        follow_landing(lake, str(landing)).awaitTermination()
    assert {status for _, _, status in ledger(lake)} == {"PENDING"}
    monkeypatch.setattr(Lake, "roll_up", inner)
    follow_landing(lake, str(landing)).awaitTermination()
    assert ledger(lake) == [("pbj", "a.csv", "DONE"), ("providerinfo", "p.csv", "DONE")]
    assert lake.gold().months.count() == 1


def test_the_landing_folder_is_followed(spark, tmp_path):
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    pbj(landing, "a.csv", worked("1", "2024-04-01", "8"))
    providerinfo(landing, "p.csv", {CCN: "1", "state": "AL"})
    follow_landing(lake, str(landing)).awaitTermination()
    pbj(landing, "b.csv", worked("1", "2024-04-01", "9"))
    query = follow_landing(lake, str(landing))
    query.awaitTermination()
    assert sum(progress["numInputRows"] for progress in query.recentProgress) == 1
    assert [int(r.hrs_rn) for r in lake.daily.read().collect()] == [9]
    assert [name for _, name, _ in ledger(lake)] == ["a.csv", "b.csv", "p.csv"]


def test_small_batches_and_pending_files(spark, tmp_path):
    """Files are loaded a few at a time, and what was left out can be tried again."""
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    for n in range(3):
        pbj(landing, f"{n}.csv", worked("1", "2024-04-01", str(n)), worked(str(n + 5), "2024-04-01", "1"))
    bad = pbj(landing, "bad.csv", worked("9", "2024-04-01", "8"), worked("9", "2024-04-01", "9"))
    assert len(run_ingest(lake, str(landing), batch_files=2)) == 1
    assert {r.ccn: int(r.hrs_rn) for r in lake.daily.read().collect()} == {
        "000001": 2, "000005": 1, "000006": 1, "000007": 1}
    bad.write_text("\n".join(bad.read_text().splitlines()[:2]) + "\n")
    assert retry(lake) == []
    assert {status for _, _, status in ledger(lake)} == {"DONE"} and lake.daily.read().count() == 5


def test_scratch_files_of_a_load_are_removed(spark, tmp_path):
    from wardlake.session import shared_folder

    def batches():
        names = Folder(spark, shared_folder(spark)).names()
        return {name for name in names if name.split("-")[0] in ("batch", "arrivals", "waiting")}

    before = batches()
    lake = Lake(spark, str(tmp_path / "lake"))
    pbj(tmp_path / "landing", "a.csv", worked("1", "2024-04-01", "8"))
    providerinfo(tmp_path / "landing", "p.csv", {CCN: "1", "state": "AL"})
    run_ingest(lake, str(tmp_path / "landing"))
    left = {name for name in batches() - before if Folder(spark, f"{shared_folder(spark)}/{name}").names()}
    assert left == set()


# --- catalog

def test_views_in_the_catalog(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.daily.merge(days(
        spark, day("2024-04-01", "AL", "1", rn=8, residents=10, ctr=3), day("2024-04-02", "AL", "1", cna=5, residents=0),
        day("2024-05-01", "GA", "2", rn=2)))
    lake.quarterly.merge(spark.createDataFrame([beds("1", "AL", 100)], GOLD_QUARTERLY))
    lake.facilities.merge(spark.createDataFrame([facility("1", "Oak", "AL")], GOLD_FACILITY_DIM))
    spark.sql("CREATE DATABASE lasting")
    try:
        catalog.define_lake(lake, "lasting")
        other = spark.newSession()
        for name, view in views.VIEWS.items():
            shown, made = other.sql(f"SELECT * FROM lasting.{name}"), view(lake.gold())
            assert shown.columns == made.columns
            assert [kind for _, kind in shown.dtypes] == [kind for _, kind in made.dtypes]
            assert sorted(shown.collect(), key=str) == sorted(made.collect(), key=str)
        lake.daily.merge(days(spark, day("2024-06-01", "GA", "2", rn=2)))
        catalog.define_lake(lake, "lasting")
        assert other.sql("SELECT count(*) AS n FROM lasting.gold_vw_total_nurse_hours_state_monthly").first().n == 3
    finally:
        spark.sql("DROP DATABASE lasting CASCADE")
    assert lake.daily.read().count() == 4


def test_raw_tables_in_the_catalog(spark, tmp_path):
    for folder, ccn in (("x", "1"), ("y", "2")):
        pbj(tmp_path / folder, "a.csv", worked(ccn, "2024-04-01", 'say "8", or 9'))
    spark.sql("CREATE DATABASE raw")
    try:
        for folder in ("x", "y"):
            catalog.define_bronze(spark, "raw", {"pbj": str(tmp_path / folder / "bronze/pbj")}, escape='"')
        rows = spark.newSession().table(f"raw.{catalog.BRONZE_VIEWS['pbj']}").collect()
        assert [(r.PROVNUM, r.Hrs_RN) for r in rows] == [("2", 'say "8", or 9')]
    finally:
        spark.sql("DROP DATABASE raw CASCADE")
    assert next(csv.reader(open(tmp_path / "x/bronze/pbj/a.csv")))


def test_ingest_of_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert ingest(lake, arrivals(spark)) == [] and retry(lake) == []
    assert lake.gold().months.count() == 0 and lake.facility_counts().count() == 0


def test_expiry_of_a_lake(spark, tmp_path):
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    for n in range(3):
        pbj(landing, f"{n}.csv", worked("1", "2024-04-01", str(n)))
        run_ingest(lake, str(landing))
    folders = Folder(spark, f"{lake.path}/gold_daily_staffing_fact/data")
    assert len(folders.names()) == 3
    lake.expire(keep=1, seconds=0)
    assert len(folders.names()) == 1
    assert [int(r.hrs_rn) for r in lake.daily.read().collect()] == [2] and lake.gold().months.count() == 1
    pbj(landing, "3.csv", worked("1", "2024-04-01", "3"))
    run_ingest(lake, str(landing))
    assert [int(r.hrs_rn) for r in lake.daily.read().collect()] == [3]
    assert len(ledger(lake)) == 4
