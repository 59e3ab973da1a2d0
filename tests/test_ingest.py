import csv
import os
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardlake.plans import views
from wardlake.schemas import BRONZE_PBJ, BRONZE_PROVIDERINFO
from wardlake.sources.bronze import read_bronze_pbj, register_bronze
from wardlake.sources.events import route_events
from wardlake.sources.ledger import FileLedger
from wardlake.plans.silver import silver_pbj
from wardlake.streaming.ingest import Lake, ingest, run_ingest

CCN = "cms_certification_number_(ccn)"


def drop_file(landing, folder, name, schema, rows):
    path = landing / folder
    path.mkdir(parents=True, exist_ok=True)
    with open(path / name, "w", newline="") as out:
        writer = csv.DictWriter(out, schema.names, restval="", quoting=csv.QUOTE_ALL)
        writer.writeheader()
        writer.writerows(rows)
    time.sleep(0.05)  # the next file is younger
    return path / name


def pbj(landing, name, *rows):
    return drop_file(landing, "bronze/pbj", name, BRONZE_PBJ, rows)


def providerinfo(landing, name, *rows):
    return drop_file(landing, "bronze/providerinfo", name, BRONZE_PROVIDERINFO, rows)


def worked(ccn, day, rn, state="al"):
    return {"PROVNUM": ccn, "WorkDate": day, "STATE": state, "Hrs_RN": rn, "MDScensus": "10"}


def ledger(lake):
    return sorted((r.dataset, r.s3_path.rsplit("/", 1)[1], r.status) for r in lake.ledger.read().collect())


@pytest.mark.parametrize("state_folders", [False, True])
def test_files_flow_to_gold_one_by_one(spark, tmp_path, state_folders):
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"), state_folders)
    providerinfo(landing, "p1.csv",
                 {CCN: "15009", "provider_name": "Oak", "state": "al", "number_of_fines": "2",
                  "number_of_certified_beds": "100", "latitude": "33.5", "longitude": "-86.5"})
    pbj(landing, "a.csv", worked("15009", "2024-04-01", "8"), worked("15009", "20240501", "9"),
        worked("", "2024-04-01", "5"), worked("15009", "never", "5"))
    drop_file(landing, "elsewhere", "c.csv", BRONZE_PBJ, [worked("1", "2024-04-01", "1")])
    run_ingest(lake, str(landing))
    assert ledger(lake) == [("pbj", "a.csv", "DONE"), ("providerinfo", "p1.csv", "DONE")]
    # Measures are there from the first load on.
    assert lake.silver_providerinfo.read().first().number_of_fines == 2
    assert lake.quarterly.read().first().fines_count_reported == 2

    pbj(landing, "b.csv", worked("15009", "2024-04-01", "7"), worked("15010", "2024-04-02", "1"))
    providerinfo(landing, "p2.csv", {CCN: "015009", "state": "AL", "number_of_certified_beds": "80"})
    run_ingest(lake, str(landing))
    hours = {(r.ccn, r.workdate.isoformat()): r.hrs_rn for r in lake.silver_pbj.read().collect()}
    assert hours == {
        ("015009", "2024-04-01"): Decimal(7), ("015009", "2024-05-01"): Decimal(9),
        ("015010", "2024-04-02"): Decimal(1),
    }
    tables = lake.gold()
    total = views.hours_facility_monthly(tables).where("month = '2024-04-01'").collect()
    assert {(r.ccn, r.provider_name): r.total_hours_direct for r in total} == {
        ("015009", "Oak"): Decimal(7), ("015010", None): Decimal(1),
    }
    # Blank cells of the second file kept what was known; its new value came in.
    dim = lake.facilities.read().collect()
    assert [(r.ccn, r.provider_name, r.latitude) for r in dim] == [("015009", "Oak", Decimal("33.5"))]
    assert lake.quarterly.read().first().certified_beds_reported == 80

    lake.register()
    monthly = spark.sql("""
        SELECT state, month, COUNT(DISTINCT ccn) AS n
        FROM gold_vw_total_nurse_hours_facility_monthly
        WHERE CAST(month AS DATE) BETWEEN DATE '2024-04-01' AND DATE '2024-05-01'
        GROUP BY 1, 2 ORDER BY month""")
    assert [(r.state, r.n) for r in monthly.collect()] == [("AL", 2), ("AL", 1)]
    assert spark.sql("SELECT count(*) AS n FROM file_log WHERE status = 'DONE'").first().n == 4

    before = lake.ledger.read().collect()
    run_ingest(lake, str(landing))
    assert sorted(lake.ledger.read().collect()) == sorted(before)
    assert lake.daily.read().count() == 3


def test_a_bad_file_stays_pending_and_blocks_no_other(spark, tmp_path):
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    bad = pbj(landing, "bad one.csv", worked("1", "2024-04-01", "8"), worked("1", "2024-04-01", "9"))
    pbj(landing, "good.csv", worked("2", "2024-04-01", "5"))
    providerinfo(landing, "p.csv", {CCN: "1", "state": "AL"}, {CCN: "1", "state": "AL"})
    providerinfo(landing, "q.csv", {CCN: "2", "state": "AL"})
    for _ in range(2):
        left = run_ingest(lake, str(landing))
        assert [path.rsplit("/", 1)[1] for path in left] == ["bad one.csv", "p.csv"]
        assert ledger(lake) == [
            ("pbj", "bad one.csv", "PENDING"), ("pbj", "good.csv", "DONE"),
            ("providerinfo", "p.csv", "PENDING"), ("providerinfo", "q.csv", "DONE")]
    assert [r.ccn for r in lake.daily.read().collect()] == ["000002"]
    # The repaired file takes the place of the bad one.
    content = bad.read_text().splitlines()
    bad.write_text("\n".join(content[:2]) + "\n")
    run_ingest(lake, str(landing))
    assert {status for _, name, status in ledger(lake) if name == "bad one.csv"} == {"DONE"}
    assert {r.ccn: r.hrs_rn for r in lake.daily.read().collect()} == {"000001": Decimal(8), "000002": Decimal(5)}


def test_no_arrival_is_lost(spark, tmp_path):
    """A file of old age, a file without rows, and new content under a known name."""
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    first = pbj(landing, "a.csv", worked("1", "2024-04-01", "8"))
    old = pbj(landing, "old+[1].csv", worked("1", "2024-04-01", "3"), worked("2", "2024-04-01", "4"))
    os.utime(old, (1_600_000_000, 1_600_000_000))
    pbj(landing, "none.csv")
    assert run_ingest(lake, str(landing)) == []
    assert ledger(lake) == [("pbj", name, "DONE") for name in ("a.csv", "none.csv", "old+[1].csv")]
    hours = lambda: {r.ccn: r.hrs_rn for r in lake.daily.read().collect()}
    assert hours() == {"000001": Decimal(8), "000002": Decimal(4)}  # the later content wins

    first.write_text(first.read_text().replace('"8"', '"9"'))
    os.utime(first, (2_000_000_000, 2_000_000_000))
    assert run_ingest(lake, str(landing)) == []
    assert hours() == {"000001": Decimal(9), "000002": Decimal(4)}
    assert [name for _, name, _ in ledger(lake)].count("a.csv") == 2
    before = ledger(lake)
    run_ingest(lake, str(landing))
    assert ledger(lake) == before


def test_blank_cells_keep_earlier_values_within_a_batch_too(spark, tmp_path):
    landing = tmp_path / "landing"
    lake = Lake(spark, str(tmp_path / "lake"))
    providerinfo(landing, "z.csv", {CCN: "1", "provider_name": "Oak", "state": "AL", "number_of_fines": "1"})
    providerinfo(landing, "b.csv", {CCN: "1", "number_of_fines": "2"})
    run_ingest(lake, str(landing))
    row = lake.silver_providerinfo.read().first()
    assert (row.provider_name, row.state, row.number_of_fines) == ("Oak", "AL", 2)


def test_work_does_not_grow_with_the_number_of_files(spark, tmp_path):
    def stages(n):
        landing = tmp_path / f"landing{n}"
        lake = Lake(spark, str(tmp_path / f"lake{n}"))
        for k in range(n):
            pbj(landing, f"{k}.csv", worked(str(k + 1), "2024-04-01", "8"))
        tag = f"ingest-{n}"
        spark.addTag(tag)
        run_ingest(lake, str(landing))
        spark.removeTag(tag)
        assert lake.daily.read().count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))

    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    few = stages(2) - before
    many = stages(12) - before - few
    assert many <= few + 3


def test_routed_events_start_the_chain(spark, tmp_path):
    landing = tmp_path / "landing"
    path = pbj(landing, "a b.csv", worked("1", "2024-04-01", "8"))
    lake = Lake(spark, str(tmp_path / "lake"))
    arrivals = spark.createDataFrame([("pbj", f"file:{path}")], "dataset string, s3_path string")
    arrivals = arrivals.withColumn("modified", F.current_timestamp())
    assert ingest(lake, arrivals) == []
    assert lake.daily.read().count() == 1 and ledger(lake) == [("pbj", "a b.csv", "DONE")]


def test_no_landing_folder_is_no_work(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    run_ingest(lake, str(tmp_path / "landing"))
    assert lake.ledger.read().count() == 0
    assert lake.gold().daily.count() == 0


def test_one_source_file_can_be_picked(spark, tmp_path):
    pbj(tmp_path, "a.csv", worked("1", "2024-04-01", "8"))
    second = pbj(tmp_path, "b.csv", worked("2", "2024-04-01", "9"))
    bronze = read_bronze_pbj(spark, str(tmp_path / "bronze/pbj"))
    path = bronze.where("PROVNUM = '2'").first().source_path
    assert path.endswith(second.name)
    assert [r.ccn for r in silver_pbj(bronze, path).collect()] == ["000002"]
    assert silver_pbj(bronze).count() == 2
    # The same in SQL, with the path as a parameter.
    register_bronze(spark, {"pbj": str(tmp_path / "bronze/pbj")})
    picked = spark.sql(
        "SELECT PROVNUM FROM bronze_pbj_daily_nurse_staffing_q2_2024_csv "
        "WHERE source_path = :source_path", args={"source_path": path})
    assert [r.PROVNUM for r in picked.collect()] == ["2"]


def test_events_can_arrive_as_a_stream(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{"detail": {"bucket": {"name": "b"}, "object": {"key": "bronze/pbj/x.csv"}}}\n'
        '{"detail": {"bucket": {"name": "b"}, "object": {"key": "other/x.csv"}}}\n')
    routed = route_events(spark.readStream.text(str(tmp_path)), "value")
    query = (routed.writeStream.format("memory").queryName("routed_events")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    assert [r.s3_path for r in spark.table("routed_events").collect()] == ["s3://b/bronze/pbj/x.csv"]


def test_quotes_and_escapes(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    cells = ['"1"', '"O\\"Hara, Home"'] + [""] * 31
    (folder / "a.csv").write_text(",".join(BRONZE_PBJ.names) + "\n" + ",".join(cells) + "\n")
    row = read_bronze_pbj(spark, str(folder)).first()
    assert (row.PROVNAME, row.CITY) == ('O"Hara, Home', None)
    cells[1] = '"O""Hara"'
    (folder / "a.csv").write_text(",".join(BRONZE_PBJ.names) + "\n" + ",".join(cells) + "\n")
    assert read_bronze_pbj(spark, str(folder), escape='"').first().PROVNAME == 'O"Hara'


def test_events_are_routed_or_dropped(spark):
    def body(key):
        return '{"detail": {"bucket": {"name": "b"}, "object": {"key": "%s"}}}' % key

    keys = ["bronze/pbj/x/y.csv", "bronze/providerinfo/z.csv", "silver/pbj/x.csv", "xbronze/pbj/a.csv"]
    events = spark.createDataFrame([(body(key),) for key in keys] + [("not json",)], "body string")
    rows = sorted((r.dataset, r.s3_path) for r in route_events(events).collect())
    assert rows == [("pbj", "s3://b/bronze/pbj/x/y.csv"),
                    ("providerinfo", "s3://b/bronze/providerinfo/z.csv")]


def test_done_reaches_every_row_of_the_path_so_far(spark, tmp_path):
    log = FileLedger(spark, str(tmp_path))

    def arrive(*rows):
        log.pending(spark.createDataFrame(
            [("pbj", path, datetime(2024, 4, day)) for path, day in rows],
            "dataset string, s3_path string, modified timestamp"))

    arrive(("f1", 1), ("f1", 1))  # told twice
    arrive(("f1", 1), ("f2", 1))  # a retry, and a new one
    log.done(spark.createDataFrame([("f1",)], "s3_path string"))
    arrive(("f1", 2))  # arrived again later
    rows = sorted((r.s3_path, r.status, r.processed_ts is None) for r in log.read().collect())
    assert rows == [("f1", "DONE", False), ("f1", "PENDING", True), ("f2", "PENDING", True)]
    assert sorted(r.s3_path for r in log.waiting("pbj").collect()) == ["f1", "f2"]
