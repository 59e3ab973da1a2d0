import threading
from datetime import date

import pytest
from pyspark.errors import AnalysisException, UnsupportedOperationException
from pyspark.sql import functions as F
from small import day

from wardlake.functions.measures import month_of
from wardlake.operators.upsert import upsert
from wardlake.schemas import GOLD_DAILY, GOLD_FACILITY_DIM
from wardlake.sources import tables
from wardlake.sources.export import export_csv, export_ordered
from wardlake.sources.tables import LakeTable, merge_into_catalog


def daily_table(spark, path, **layout):
    return LakeTable(
        spark, str(path), GOLD_DAILY, ("ccn", "workdate"),
        slice_name="month", slice_of=month_of("workdate"), **layout,
    )


def fact(spark, *days):
    return spark.createDataFrame(list(days), GOLD_DAILY)


def hours(table):
    return {(r.ccn, r.workdate.isoformat(), r.state): int(r.hrs_rn) for r in table.read().collect()}


@pytest.mark.parametrize("layout", [{}, {"cluster_by": ("state", "ccn")},
                                    {"partition_by": ("state",), "cluster_by": ("ccn",)}])
def test_merge_rewrites_only_the_months_of_the_source(spark, tmp_path, layout):
    table = daily_table(spark, tmp_path, **layout)
    assert table.read().count() == 0
    table.merge(fact(spark, day("2024-04-01", "AL", "1", rn=1), day("2024-05-01", "AL", "1", rn=2)))
    # A correction may also move a row to another state.
    table.merge(fact(spark, day("2024-05-01", "GA", "1", rn=9), day("2024-05-02", "AL", "2", rn=3)))
    assert hours(table) == {
        ("1", "2024-04-01", "AL"): 1, ("1", "2024-05-01", "GA"): 9, ("2", "2024-05-02", "AL"): 3,
    }
    current = table.current()
    assert set(current) == {"2024-04-01", "2024-05-01"} and current["2024-04-01"] != current["2024-05-01"]


def test_month_predicate_skips_folders(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    table.merge(fact(spark, day("2024-04-01", "AL", "1", rn=1), day("2024-05-01", "AL", "1", rn=2)))
    plan = table.read().where("month = '2024-05-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_rows_without_a_key_are_left_out_and_reloading_changes_nothing(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    rows = fact(spark, day("2024-04-01", "AL", "1", rn=1), day("2024-04-01", "AL", None, rn=2))
    table.merge(rows)
    table.merge(rows)
    assert hours(table) == {("1", "2024-04-01", "AL"): 1}


def test_a_source_without_usable_rows_is_no_write(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    table.merge(fact(spark, day("2024-04-01", "AL", None, rn=2)))
    assert table.current() == {}


def test_a_write_that_was_not_finished_is_invisible(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    table.merge(fact(spark, day("2024-04-01", "AL", "1", rn=1)))
    # Files of a next generation without its log entry, as after a crash.
    orphan = fact(spark, day("2024-04-01", "AL", "1", rn=777)).withColumn("month", F.lit(date(2024, 4, 1)))
    orphan.write.partitionBy("month").parquet(f"{tmp_path}/data/write=lost")
    assert hours(table) == {("1", "2024-04-01", "AL"): 1}
    table.merge(fact(spark, day("2024-04-02", "AL", "1", rn=5)))
    assert hours(table) == {("1", "2024-04-01", "AL"): 1, ("1", "2024-04-02", "AL"): 5}


def test_a_failed_merge_leaves_the_table_as_it_was(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    table.merge(fact(spark, day("2024-04-01", "AL", "1", rn=1)))
    doubled = fact(spark, day("2024-04-01", "AL", "1", rn=2), day("2024-04-01", "AL", "1", rn=3))
    with pytest.raises(Exception, match="more than one source row"):
        table.merge(doubled)
    assert hours(table) == {("1", "2024-04-01", "AL"): 1}


def test_whole_table_slice(spark, tmp_path):
    table = LakeTable(spark, str(tmp_path), GOLD_FACILITY_DIM, ("ccn",), cluster_by=("state", "ccn"))
    for name in ("Oak", "Elm"):
        table.merge(spark.createDataFrame(
            [("1", name, "AL", None, None, None, None, None)], GOLD_FACILITY_DIM))
    assert [(r.ccn, r.provider_name) for r in table.read().collect()] == [("1", "Elm")]


def test_parquet_tables_have_no_native_merge(spark):
    spark.createDataFrame([("1", 1)], "ccn string, v int").createOrReplaceTempView("plain")
    source = spark.createDataFrame([("1", 2)], "ccn string, v int")
    with pytest.raises(UnsupportedOperationException, match="does not support MERGE"):
        merge_into_catalog("plain", source, ["ccn"])


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1), (None, 2)], "x string, n int")
    export_csv(df, f"{tmp_path}/out")
    back = spark.read.option("header", True).schema(df.schema).csv(f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(AnalysisException):
        export_csv(df, f"{tmp_path}/out")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_bucketed_merge_shuffles_the_source_only(spark, tmp_path):
    """No exchange above the stored rows, and the rows of an unbucketed merge."""
    plain, dealt = daily_table(spark, tmp_path / "a"), daily_table(spark, tmp_path / "b", buckets=4)
    first = [day("2024-04-%02d" % (n % 28 + 1), "AL", str(n), rn=n) for n in range(60)]
    second = [day("2024-04-01", "GA", "0", rn=70), day("2024-04-30", "AL", "x", rn=71), day("2024-05-01", "AL", "1", rn=3)]
    for table in (plain, dealt):
        for rows in (first, second):
            table.merge(fact(spark, *rows))
    assert sorted(dealt.read().collect(), key=str) == sorted(plain.read().collect(), key=str)
    names = [path.rsplit("/", 1)[1] for path in dealt.read(["2024-04-01"]).inputFiles()]
    assert len({name.split("_")[1][:5] for name in names}) == 4  # a file for each bucket
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with dealt.in_buckets() as target:
            merged = upsert(target, fact(spark, *second), ["ccn", "workdate"], on_null_key="reject", partitions=4)
            plan = plan_of(merged)
            assert merged.count() == 62
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    stored, arriving = plan.split("FileScan")[0], plan.split("FileScan")[1]
    assert "Exchange" not in stored and "Bucketed: true" in arriving and arriving.count("Exchange") == 1


def test_a_large_merge_is_not_held_to_a_task_per_bucket(spark, tmp_path, monkeypatch):
    """Small merges go bucket by bucket, larger ones as their rows need; the files are the same."""
    monkeypatch.setattr(tables, "BUCKET_ROWS", 20, raising=False)
    held, inner = [], tables.upsert

    def upserted(*given, **rules):
        held.append(rules.get("partitions", 0))
        return inner(*given, **rules)

    monkeypatch.setattr(tables, "upsert", upserted)
    plain, dealt = daily_table(spark, tmp_path / "a"), daily_table(spark, tmp_path / "b", buckets=2)
    few = [day("2024-04-01", "AL", str(n), rn=n) for n in range(20)]
    many = [day("2024-%02d-01" % (n % 2 + 4), "AL", str(n), rn=2 * n) for n in range(90)]
    later = [day("2024-04-01", "GA", "1", rn=70)]
    for rows in (few, many, later):
        for table in (plain, dealt):
            table.merge(fact(spark, *rows, (None, *day("2024-04-01", "AL", "x", rn=1)[1:])))
    assert held[1::2] == [2, 0, 0]  # of ``dealt``; before the last merge April has 55 rows
    assert sorted(dealt.read().collect(), key=str) == sorted(plain.read().collect(), key=str)
    assert len(hours(dealt)) == 100
    for month in ("2024-04-01", "2024-05-01"):
        assert len({path.split("_")[-1][:5] for path in dealt.read([month]).inputFiles()}) == 2


def test_a_folder_has_one_file_however_many_its_first_cluster_values(spark, tmp_path):
    """Folders are not dealt out over all tasks, which would make files by folders times tasks."""
    rows = [day("2024-%02d-01" % (n % 12 + 1), "AL" if n % 5 else "GA", str(n), rn=n) for n in range(600)]
    df = fact(spark, *rows).withColumn("month", month_of("workdate")).repartition(4)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesced)
    spark.conf.set(coalesced, "false")  # so little data would go through one task
    try:
        tables.write_partitioned(df, f"{tmp_path}/t", ["month", "state"], ["ccn"])
    finally:
        spark.conf.set(coalesced, before)
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert stored.count() == 600 and len(stored.inputFiles()) == 24


def test_buckets_need_rejected_null_keys(spark):
    rows = fact(spark, day("2024-04-01", "AL", "1", rn=1))
    with pytest.raises(ValueError, match="no bucket"):
        upsert(rows, rows, ["ccn", "workdate"], partitions=2)


@pytest.mark.parametrize("buckets", [0, 2])
def test_concurrent_loads_of_one_month_both_show(spark, tmp_path, buckets):
    table = daily_table(spark, tmp_path, buckets=buckets)
    table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=1)))
    failures = []

    def load(ccn):
        try:
            table.merge(fact(spark, day("2024-04-01", "AL", ccn, rn=2), day(f"2024-0{ccn}-01", "AL", ccn, rn=3)))
        except Exception as problem:  # shown by the assertion below
            failures.append(problem)

    loads = [threading.Thread(target=load, args=(str(n),)) for n in range(5, 8)]
    for thread in loads:
        thread.start()
    for thread in loads:
        thread.join()
    assert failures == []
    assert hours(table) == {("0", "2024-04-01", "AL"): 1} | {
        (str(n), f"2024-0{month}-01", "AL"): rn for n in range(5, 8) for month, rn in ((4, 2), (n, 3))
    }


def test_a_merge_is_computed_again_if_its_slice_changed(spark, tmp_path, monkeypatch):
    table = daily_table(spark, tmp_path)
    table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=1)))
    computed, inner = [], LakeTable._merged

    def interrupted(self, current, slices, source, rules):
        computed.append(slices)
        if len(computed) == 1:
            table.merge(fact(spark, day("2024-04-02", "AL", "other", rn=5), day("2024-06-01", "AL", "other", rn=6)))
        return inner(self, current, slices, source, rules)

    monkeypatch.setattr(LakeTable, "_merged", interrupted)
    table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=2)))
    assert hours(table) == {
        ("0", "2024-04-01", "AL"): 2, ("other", "2024-04-02", "AL"): 5, ("other", "2024-06-01", "AL"): 6,
    }
    assert computed == [["2024-04-01"], ["2024-04-01", "2024-06-01"], ["2024-04-01"]]


def test_another_slice_is_no_conflict(spark, tmp_path, monkeypatch):
    table = daily_table(spark, tmp_path)
    computed, inner = [], LakeTable._merged

    def interrupted(self, current, slices, source, rules):
        computed.append(slices)
        if len(computed) == 1:
            table.merge(fact(spark, day("2024-06-01", "AL", "other", rn=6)))
        return inner(self, current, slices, source, rules)

    monkeypatch.setattr(LakeTable, "_merged", interrupted)
    table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=2)))
    assert computed == [["2024-04-01"], ["2024-06-01"]]
    assert len(hours(table)) == 2


def test_expiry_keeps_what_readers_hold(spark, tmp_path):
    table = daily_table(spark, tmp_path, buckets=2)
    for rn in (1, 2):
        table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=rn), day("2024-05-01", "AL", "0", rn=9 * rn)))
    with table.held() as rows:
        for rn in (3, 4):
            table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=rn)))
        gone = table.expire(keep=1, seconds=0)
        # The first write and the April of the third are needed by nobody.
        assert len(gone) == 2
        assert sorted(int(row.hrs_rn) for row in rows.collect()) == [2, 18]
    assert sorted(hours(table).values()) == [4, 18]
    assert [name.split("/")[1] for name in table.expire(keep=1, seconds=0)] == ["month=2024-04-01"]
    assert sorted(hours(table).values()) == [4, 18]
    assert table.expire(keep=1, seconds=0) == []


def test_expiry_leaves_young_folders_of_unfinished_writes(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=1)))
    lost = fact(spark, day("2024-04-01", "AL", "0", rn=2)).withColumn("month", F.lit(date(2024, 4, 1)))
    lost.write.partitionBy("month").parquet(f"{tmp_path}/data/write=lost")
    assert table.expire(keep=1, seconds=3600) == []
    assert table.expire(keep=1, seconds=0) == ["write=lost"]
    assert sorted(hours(table).values()) == [1]


def test_rows_as_of_a_commit(spark, tmp_path):
    table = daily_table(spark, tmp_path)
    for rn in (1, 2):
        table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=rn)))
    assert [int(row.hrs_rn) for row in table.read(number=1).collect()] == [1]


@pytest.mark.parametrize("layout", [{}, {"buckets": 2}])
def test_a_table_in_the_catalog(spark, tmp_path, layout):
    """Other sessions of the catalog read it; dropping the entry leaves the files."""
    table = daily_table(spark, tmp_path, **layout)
    table.merge(fact(spark, day("2024-04-01", "AL", "0", rn=1), day("2024-05-01", "AL", "0", rn=2)))
    table.define("lake_daily")
    other = spark.newSession()
    assert other.sql("SELECT sum(hrs_rn) AS h FROM lake_daily WHERE month = DATE'2024-05-01'").first().h == 2
    table.merge(fact(spark, day("2024-05-01", "AL", "0", rn=7)))
    table.define("lake_daily")
    assert other.sql("SELECT sum(hrs_rn) AS h FROM lake_daily").first().h == 8
    spark.sql("DROP TABLE lake_daily")
    assert len(hours(table)) == 2


def joined(folder):
    return b"".join(path.read_bytes() for path in sorted(folder.glob("part-*")))


def test_an_ordered_export_is_one_file_in_pieces(spark, tmp_path):
    rows = [(n * 7919 % 1000, f'say "{n}", or\\ {n % 3}' if n % 5 else None, n % 7 or None) for n in range(1000)]
    df = spark.createDataFrame(rows, "x long, `the name` string, n int").repartition(8)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesced)
    spark.conf.set(coalesced, "false")  # so little data would go into one part
    try:
        export_ordered(df, f"{tmp_path}/out", "-n", "x")
    finally:
        spark.conf.set(coalesced, before)
    one = df.orderBy(F.desc_nulls_last("n"), "x").coalesce(1)
    one.write.option("header", True).csv(f"{tmp_path}/one")
    assert len(list((tmp_path / "out").glob("part-*"))) > 2
    assert joined(tmp_path / "out") == joined(tmp_path / "one")
    assert joined(tmp_path / "out").count(b"the name") == 1
    with pytest.raises(AnalysisException):
        export_ordered(df, f"{tmp_path}/out", "x")


def test_an_ordered_export_of_nothing_is_a_header(spark, tmp_path):
    export_ordered(spark.createDataFrame([], "x long, y string"), f"{tmp_path}/out", "x")
    assert joined(tmp_path / "out") == b"x,y\n"
