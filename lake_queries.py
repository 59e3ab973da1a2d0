"""Registered queries over stored lakes: streams, merges, commits, ledger, roll-up and catalog.

Each builds its lake from the given tables in the shared folder and returns what can be read from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from wardlake.operators.selection import Selection
from wardlake.plans import catalog, gold, silver, views
from wardlake.schemas import GOLD_DAILY
from wardlake.session import delete_scratch, scratch_path, shuffles_cleaned, written
from wardlake.sources import sample
from wardlake.sources.bronze import read_bronze_pbj, read_bronze_providerinfo
from wardlake.sources.events import PREFIXES, route_events
from wardlake.sources.ledger import FileLedger
from wardlake.sources.tables import empty
from wardlake.streaming.ingest import Lake, follow_events, follow_landing, landed_files

CHOSEN_START, CHOSEN_END = date.fromisoformat(oracles.CHOSEN_START), date.fromisoformat(oracles.CHOSEN_END)
PIECES = 3  # files per dataset and round
ROUNDS = (False, True)


def _lake(spark: SparkSession, buckets: int = 2) -> Lake:
    return Lake(spark, scratch_path(spark, "lake"), buckets=buckets)


def _land(spark: SparkSession, sf_dir: str, fact: DataFrame, landing: str, second: bool) -> None:
    """Add ``PIECES`` files per dataset to the landing folder, large ones in pieces of their own."""
    sample.land_pbj(fact, f"{landing}/{PREFIXES['pbj']}", second, files=PIECES)
    raw = sample.bronze_providerinfo(spark, sf_dir, second)
    sample.write_files(raw, f"{landing}/{PREFIXES['providerinfo']}", files=PIECES, compression="gzip")


def _silver_pbj(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    path = scratch_path(spark, "raw")
    sample.write_raw(sample.bronze_pbj(spark, sf_dir, second), path)
    # Kept, as a merge looks at its rows more than once.
    return written(silver.silver_pbj(read_bronze_pbj(spark, path)), "silver")


def _silver_providerinfo(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    path = scratch_path(spark, "raw")
    sample.write_raw(sample.bronze_providerinfo(spark, sf_dir, second), path)
    return silver.silver_providerinfo(read_bronze_providerinfo(spark, path))


def _hours_and_ledger(lake: Lake, files: DataFrame) -> DataFrame:
    """State months of the lake, and the arrivals of whole files in its ledger by dataset and status."""
    hours = views.hours_state_monthly(lake.gold()).select(
        F.lit("hours").alias("part"), F.col("state").alias("name"), "month", F.col("total_hours_direct").alias("value")
    )
    # The pieces of a file that arrived at one time are one arrival; it waits while any of them does.
    log = lake.ledger.arrivals().join(files.select("s3_path", "turn", "nth"), "s3_path")
    log = log.groupBy("dataset", "turn", "nth", "modified").agg(F.max("status").alias("status"))
    log = log.groupBy("dataset", "status").agg(F.count(F.lit(1)).alias("n"))
    return hours.unionByName(log.select(
        F.lit("ledger").alias("part"), F.concat_ws(" ", "dataset", "status").alias("name"),
        F.lit(None).cast("date").alias("month"), F.col("n").cast("decimal(38,2)").alias("value"),
    ))


def _messages(spark: SparkSession, sf_dir: str, files: DataFrame, turn: int) -> DataFrame:
    """Every second event as the message that a landed file has arrived, most of them more than once.

    Of a file in pieces a message names one in turn; the pieces are named by the file's first message as well.
    """
    number = F.col("event_id")
    folder = F.element_at(
        F.array(*(F.lit(prefix) for prefix in PREFIXES.values()), F.lit("archive/pbj/")),
        (F.floor(number / 2) % 3 + 1).cast("int"),
    )
    events = sample.table(spark, sf_dir, "events").where(number % 2 == turn).select(
        "event_id", F.col("ts").alias("arrived"), folder.alias("folder"), (F.floor(number / 6) % PIECES).alias("nth")
    )
    pieces = files.groupBy("folder", "nth").agg(F.count(F.lit(1)).alias("pieces"))
    events = events.join(pieces, ["folder", "nth"], "left").withColumn(
        "piece", F.floor(number / (6 * PIECES)) % F.coalesce("pieces", F.lit(1))
    )
    first = events.groupBy("folder", "nth").agg(F.min_by(F.struct("arrived", "piece"), "event_id").alias("first"))
    others = first.join(files, ["folder", "nth"]).where(F.col("first.piece") != F.col("piece"))
    others = others.select("folder", "first.arrived", "file")
    named = events.join(files, ["folder", "nth", "piece"], "left").select("folder", "arrived", "file")
    named = named.unionByName(others).withColumn("key", F.concat("folder", F.coalesce("file", F.lit("x.csv"))))
    body = F.to_json(F.struct(F.struct(
        F.struct(F.lit("landing").alias("name")).alias("bucket"), F.struct("key").alias("object")
    ).alias("detail")))
    return named.select(body.alias("body"), F.col("arrived").cast("timestamp").alias("arrived"))


def follow_events_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by a stream of messages, which ends once in between and is taken up again."""
    landing, told, lake = scratch_path(spark, "landing"), scratch_path(spark, "events"), _lake(spark)
    fact = written(sample.daily_fact(spark, sf_dir), "fact")
    seen: set[str] = set()
    named: list[tuple] = []
    for turn, second in enumerate(ROUNDS):
        _land(spark, sf_dir, fact, landing, second)
        paths = [row.s3_path for row in landed_files(spark, landing).collect() if row.s3_path not in seen]
        seen.update(paths)
        for prefix in PREFIXES.values():
            mine = sorted(path.split(prefix) for path in paths if prefix in path)
            root = mine[0][0]
            named += [
                (turn, prefix, at % PIECES, at // PIECES, name, f"{root}{prefix}{name}")
                for at, (_, name) in enumerate(mine)
            ]
        files = spark.createDataFrame(
            named, "turn int, folder string, nth long, piece long, file string, s3_path string"
        )
        files = written(files.coalesce(1), "files")  # so small that it is known to be
        messages = _messages(spark, sf_dir, files.where(F.col("turn") == turn).drop("turn", "s3_path"), turn)
        with shuffles_cleaned(spark):
            messages.write.mode("append").option("compression", "gzip").json(told)
        stream = spark.readStream.schema("body string, arrived timestamp").json(told)
        follow_events(lake, stream, stores={"landing": root}).awaitTermination()
    delete_scratch(fact)
    return _hours_and_ledger(lake, files)


def follow_landing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landing folder followed as a stream: three runs, of which the last finds nothing new."""
    landing, lake = scratch_path(spark, "landing"), _lake(spark)
    fact = written(sample.daily_fact(spark, sf_dir), "fact")
    for second in (*ROUNDS, None):
        if second is not None:
            _land(spark, sf_dir, fact, landing, second)
        follow_landing(lake, landing).awaitTermination()
    delete_scratch(fact)
    return views.hours_state_monthly(lake.gold())


def bucketed_merge_pbj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver days merged into stored buckets."""
    table = _lake(spark, 4).silver_pbj
    for second in ROUNDS:
        table.merge(_silver_pbj(spark, sf_dir, second))
    return table.read().drop("month")


def bucketed_merge_providerinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver providers merged into stored buckets; blanks keep earlier values."""
    table = _lake(spark, 4).silver_providerinfo
    for second in ROUNDS:
        table.merge(_silver_providerinfo(spark, sf_dir, second), keep_old_when_null=True)
    return table.read()


def concurrent_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers that load the same months at once, each the facilities of one parity."""
    table = _lake(spark).silver_pbj
    rounds = [_silver_pbj(spark, sf_dir, second) for second in ROUNDS]

    def load(parity: int) -> None:
        for rows in rounds:
            table.merge(rows.where(F.pmod(F.col("ccn").cast("int"), F.lit(2)) == parity))

    with ThreadPoolExecutor(2) as writers:
        for done in [writers.submit(load, parity) for parity in (0, 1)]:
            done.result()
    table.expire(keep=1, seconds=0)
    return table.read().drop("month")


def compacted_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger logged in two steps with a compaction in between."""
    ledger = FileLedger(spark, scratch_path(spark, "ledger"))
    arrivals = route_events(sample.file_events(spark, sf_dir)).select(
        "event_id", "dataset", "s3_path", F.col("arrived").cast("timestamp").alias("modified")
    )
    early = arrivals.where("event_id % 4 < 2")
    ledger.pending(early)
    ledger.done(early.where("dataset = 'providerinfo'").select("s3_path").distinct())
    ledger.compact()
    ledger.pending(arrivals)
    ledger.done(arrivals.where("dataset = 'pbj' AND hour(modified) < 12").select("s3_path").distinct())
    return ledger.read().groupBy("dataset", "s3_path", "status").agg(
        F.count(F.lit(1)).alias("arrivals"), F.count("processed_ts").alias("processed")
    )


def _daily_in_two_loads(spark: SparkSession, sf_dir: str) -> Lake:
    """The daily fact of both raw files, and its facility months after each of them."""
    lake = _lake(spark)
    for second in ROUNDS:
        lake.daily.merge(gold.gold_daily(_silver_pbj(spark, sf_dir, second)))
        lake.roll_up()
    return lake


def maintained_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility months as stored after two loads, of which the second touches few months."""
    return _daily_in_two_loads(spark, sf_dir).months.read().withColumns(
        {name: F.bit_count(name) for name in ("days", "resident_days_seen")}
    )


def facilities_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct facilities over a range of months, by state and over all, without the daily fact."""
    lake = _daily_in_two_loads(spark, sf_dir)
    chosen = Selection(start=CHOSEN_START, end=CHOSEN_END)
    by_state = lake.facility_counts(chosen)
    return by_state.unionByName(lake.facility_counts(chosen, ()).withColumn("state", F.lit("all")))


def from_months(view: Callable[[views.Gold], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A view read from stored facility months; there is no daily fact to read."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, given = _lake(spark).months, sample.gold(spark, sf_dir)
        months = views.facility_months(given.daily)
        table.replace(months, table.slices_of(given.month_keys()))
        return view(views.Gold(empty(spark, GOLD_DAILY), given.quarterly, given.facilities, table.read()))

    return query


def _in_database(spark: SparkSession, build: Callable[[str], str]) -> DataFrame:
    """Run a statement in another session of the same catalog, over what ``build`` has entered there."""
    database = f"wardlake_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    return spark.newSession().sql(build(database))


def catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lasting tables and views, used from a session that has not seen the lake."""
    lake, given = _lake(spark), sample.gold(spark, sf_dir)
    lake.daily.merge(given.daily)
    lake.quarterly.merge(given.quarterly)
    lake.facilities.merge(given.facilities)
    lake.roll_up()

    def statement(database: str) -> str:
        catalog.define_lake(lake, database)
        return f"""
            SELECT v.month, v.state, v.ccn, v.provider_name, v.bed_utilization_rate_monthly, v.hprd_weighted,
                m.perm_share, h.total_hours_direct, s.hprd_weighted AS state_hprd
            FROM {database}.gold_vw_staffing_vs_occupancy v
            JOIN {database}.gold_vw_perm_vs_contract_facility_monthly m USING (month, state, ccn)
            JOIN {database}.gold_vw_total_nurse_hours_facility_monthly h USING (month, state, ccn)
            JOIN {database}.gold_vw_hprd_by_state s ON s.state = v.state
        """

    return _in_database(spark, statement)


def catalog_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lasting raw table that takes the place of an earlier one of its name."""
    paths = []
    for second in ROUNDS:
        paths.append(scratch_path(spark, "raw"))
        sample.write_raw(sample.bronze_pbj(spark, sf_dir, second), paths[-1])

    def statement(database: str) -> str:
        for path in paths:
            catalog.define_bronze(spark, database, {"pbj": path})
        table = f"{database}.{catalog.BRONZE_VIEWS['pbj']}"
        return f"SELECT trim(state) AS state, count(*) AS days, count(DISTINCT trim(provnum)) AS facilities FROM {table} GROUP BY trim(state)"

    return _in_database(spark, statement)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "follow_events": follow_events_query,
    "follow_landing": follow_landing_query,
    "bucketed_merge_pbj": bucketed_merge_pbj,
    "bucketed_merge_providerinfo": bucketed_merge_providerinfo,
    "concurrent_loads": concurrent_loads,
    "compacted_ledger": compacted_ledger,
    "maintained_months": maintained_months,
    "facilities_in_range": facilities_in_range,
    **{f"from_months_{view.__name__}": from_months(view) for view in views.VIEWS.values()},
    "catalog_views": catalog_views,
    "catalog_bronze": catalog_bronze,
}
