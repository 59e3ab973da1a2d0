"""New raw files to silver and gold in batches, with a ledger.

Arrivals come from a stream: of arrival messages (``follow_events``) or of the landing folder itself
(``follow_landing``). The stream's checkpoint in the lake remembers what has been seen, so a run
looks at what is new, and a batch that was cut off is handed out again. ``run_ingest`` lists the folders whole
instead, for a first load and to find new content under a known name. An arrival is a path and a modification time.

The arrivals of a batch are loaded together: one read, one upsert per table, and two entries in the ledger,
however many files there are. Within a batch the last arrival of a key wins, by
modification time and then path. After the daily fact its facility months are brought up to date, for the
months that changed only.

A file that holds two rows for one key is left out and stays PENDING; all others go on, in either
dataset. A batch that fails stays PENDING as a whole and is loaded again by the next run; every
step is keyed, so loading again does not change what is already there. Several writers may work on a lake
at once: their commits follow each other (``sources/commits.py``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import batched

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardlake import schemas
from wardlake.functions.measures import month_of
from wardlake.operators import distinct
from wardlake.operators.selection import Selection
from wardlake.plans import gold as gold_layer
from wardlake.plans import silver as silver_layer
from wardlake.plans import views
from wardlake.plans.views import Gold
from wardlake.session import delete_scratch, shuffles_cleaned, written
from wardlake.sources.bronze import (
    DATASETS, SOURCE_PATH, canonical_path, csv_options, with_source_path,
)
from wardlake.sources.events import PREFIXES, route_events
from wardlake.sources.ledger import TAIL, FileLedger
from wardlake.sources.tables import LakeTable

BATCH_FILES = 10_000  # files loaded together; the driver holds their names


@dataclass(frozen=True)
class Lake:
    """Every stored table of one lake folder.

    Daily tables have one folder per month and provider facts one per quarter;
    rows are sorted by state and facility within a file. ``buckets`` is the number of files by hash of
    the key in each of them, chosen so that a month's rows fill them; merges then leave the
    stored rows where they are. With ``state_folders`` each state has a folder of its own instead,
    which suits lakes that are mostly read by state.
    """

    spark: SparkSession
    path: str
    state_folders: bool = False
    buckets: int = 2

    def _table(self, name: str, schema, keys: list[str], **cut) -> LakeTable:
        layout = (
            {"partition_by": ("state",), "cluster_by": ("ccn",)}
            if self.state_folders
            else {"cluster_by": ("state", "ccn"), "buckets": self.buckets}
        )
        return LakeTable(
            self.spark, f"{self.path}/{name}", schema, tuple(keys), **layout, **cut
        )

    @property
    def silver_pbj(self) -> LakeTable:
        return self._table(
            "silver_pbj_daily", schemas.SILVER_PBJ_DAILY, silver_layer.PBJ_KEYS,
            slice_name="month", slice_of=month_of("workdate"),
        )

    @property
    def silver_providerinfo(self) -> LakeTable:
        return self._table(
            "silver_providerinfo", schemas.SILVER_PROVIDERINFO, silver_layer.PROVIDER_KEYS
        )

    @property
    def daily(self) -> LakeTable:
        return self._table(
            "gold_daily_staffing_fact", schemas.GOLD_DAILY, gold_layer.DAILY_KEYS,
            slice_name="month", slice_of=month_of("workdate"),
        )

    @property
    def quarterly(self) -> LakeTable:
        return self._table(
            "gold_quarterly_provider_fact", schemas.GOLD_QUARTERLY, gold_layer.QUARTERLY_KEYS,
            slice_name="quarter", slice_of=F.col("reporting_period_quarter"), slice_type=StringType(),
        )

    @property
    def facilities(self) -> LakeTable:
        return self._table("gold_facility_dim", schemas.GOLD_FACILITY_DIM, gold_layer.DIM_KEYS)

    @property
    def months(self) -> LakeTable:
        """Facility months of the daily fact; its commits tell which daily folder a month was made from."""
        return LakeTable(
            self.spark, f"{self.path}/facility_months", schemas.FACILITY_MONTHS, ("month", "state", "ccn"),
            cluster_by=("state", "ccn"), slice_name="month", slice_of=F.col("month"),
        )

    @property
    def numbers(self) -> LakeTable:
        """A number for every facility of the daily fact, given once and for all."""
        return LakeTable(self.spark, f"{self.path}/facility_numbers", schemas.FACILITY_NUMBERS, ("ccn",))

    @property
    def bitmaps(self) -> LakeTable:
        """Facilities of each state and month, as bitmaps of their numbers."""
        return LakeTable(
            self.spark, f"{self.path}/facility_bitmaps", schemas.FACILITY_BITMAPS, ("month", "state", "bucket"),
            cluster_by=("state", "bucket"), slice_name="month", slice_of=F.col("month"),
        )

    @property
    def ledger(self) -> FileLedger:
        return FileLedger(self.spark, f"{self.path}/file_log")

    def _stale_months(self) -> tuple[dict[str, str], list[str]]:
        """Folders of the daily fact, and its months that the facility months do not follow yet."""
        daily = self.daily.current()
        made_from = self.months.commits.latest()[1].get("made_from", {})
        return daily, sorted(month for month, folder in daily.items() if made_from.get(month) != folder)

    def roll_up(self) -> list[str]:
        """Aggregate those months again whose daily rows have changed since; returns them."""
        daily, stale = self._stale_months()
        if stale:
            months = views.facility_months(self.daily.rows(daily, stale))
            self.months.replace(months, stale, made_from={month: daily[month] for month in stale})
        self._number_facilities()
        return stale

    def _number_facilities(self) -> None:
        """Make the bitmaps again for those months whose roll-up has changed since."""
        made = self.months.current()
        noted = self.bitmaps.commits.latest()[1].get("made_from", {})
        stale = sorted(month for month, folder in made.items() if noted.get(month) != folder)
        if stale:
            months = self.months.rows(made, stale)
            self.numbers.append(lambda known: distinct.numbered(known, months, "ccn"))
            cells = months.select("month", "state", "ccn").join(self.numbers.read(), "ccn")
            self.bitmaps.replace(
                distinct.bitmaps(cells, ["month", "state"]), stale,
                made_from={month: made[month] for month in stale},
            )

    def facility_counts(self, selection: Selection = Selection(), by: tuple[str, ...] = ("state",)) -> DataFrame:
        """Distinct facilities over the selected states and months, from bitmaps alone.

        A choice of facilities is not in the bitmaps, so it is not allowed here.
        """
        if selection.ccns:
            raise ValueError("bitmaps tell states and months apart, not facilities")
        maps = self.bitmaps.read().where(selection.keys() & selection.month_between())
        return distinct.distinct_count(maps, list(by), "facilities")

    def gold(self) -> Gold:
        """The gold tables as they are now. Months that await their roll-up are aggregated when read."""
        daily, stale = self._stale_months()
        months = self.months.read([month for month in daily if month not in stale])
        if stale:
            months = months.unionByName(views.facility_months(self.daily.rows(daily, stale)))
        quarterly = self.quarterly.read().select(*schemas.GOLD_QUARTERLY.names)
        return Gold(self.daily.rows(daily), quarterly, self.facilities.read(), months)

    def tables(self) -> dict[str, LakeTable]:
        """Silver and gold tables by the names they are known by."""
        return {
            "silver_pbj_daily": self.silver_pbj, "silver_providerinfo": self.silver_providerinfo,
            "gold_daily_staffing_fact": self.daily, "gold_quarterly_provider_fact": self.quarterly,
            "gold_facility_dim": self.facilities, "gold_facility_months": self.months,
            "gold_facility_numbers": self.numbers, "gold_facility_bitmaps": self.bitmaps,
        }

    def expire(self, **rules) -> None:
        """Delete replaced files of all tables; see ``LakeTable.expire``."""
        for table in self.tables().values():
            table.expire(**rules)
        self.ledger.expire()

    def register(self) -> None:
        """Make silver, gold, the views and the ledger available to ``spark.sql``."""
        self.silver_pbj.read().createOrReplaceTempView("silver_pbj_daily")
        self.silver_providerinfo.read().createOrReplaceTempView("silver_providerinfo")
        self.ledger.read().createOrReplaceTempView("file_log")
        views.register(self.gold())

    def load(
        self, dataset: str, paths: list[str], quarter: str = gold_layer.DEFAULT_QUARTER
    ) -> list[str]:
        """Bring the files into silver and gold; returns the paths left out.

        The driver knows the names of the batch's files, never their rows.
        """
        bronze = with_source_path(
            self.spark.read.schema(DATASETS[dataset]).options(**csv_options())
            .csv([_literal(path) for path in paths])
            .select("*", "_metadata")
        ).withColumn("_modified", F.col("_metadata.file_modification_time"))
        arrival = F.struct("_modified", SOURCE_PATH)
        if dataset == "pbj":
            build, keys = silver_layer.silver_pbj, silver_layer.PBJ_KEYS
        else:
            build, keys = silver_layer.silver_providerinfo, silver_layer.PROVIDER_KEYS
        rows = written(build(bronze, None, arrival.alias("_arrival")).dropna(subset=keys), "batch")
        with shuffles_cleaned(self.spark):
            doubled = (
                rows.groupBy(*keys, "_arrival").count().where("count > 1")
                .select(F.col("_arrival")[SOURCE_PATH].alias("s3_path")).distinct()
            )
            bad = sorted(row.s3_path for row in doubled.collect())
        fine = rows.where(~F.col("_arrival")[SOURCE_PATH].isin(bad)) if bad else rows
        last = written((_last_rows if dataset == "pbj" else _last_values)(fine, keys), "batch")
        delete_scratch(rows)
        if dataset == "pbj":
            self._load_pbj(last)
        else:
            self._load_providerinfo(last, quarter)
        delete_scratch(last)
        return bad

    def _load_pbj(self, rows: DataFrame) -> None:
        months = self.silver_pbj.merge(rows)
        # A daily row is replaced as a whole, so the batch's rows are the merged rows.
        self.daily.merge(gold_layer.gold_daily(rows), slices=months)
        self.roll_up()

    def _load_providerinfo(self, rows: DataFrame, quarter: str) -> None:
        self.silver_providerinfo.merge(rows, keep_old_when_null=True)
        # Gold takes the merged rows of the batch's facilities, not all of silver.
        merged = self.silver_providerinfo.read().join(rows.select("ccn"), "ccn", "left_semi")
        merged = written(merged, "batch")
        self.quarterly.merge(
            gold_layer.gold_quarterly(merged, quarter), update=gold_layer.QUARTERLY_UPDATES
        )
        self.facilities.merge(gold_layer.gold_facility_dim(merged))
        delete_scratch(merged)


# Fixed value: the columns that Spark reads files with as a whole.
_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def _literal(path: str) -> str:
    """A path whose wildcard characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _others(rows: DataFrame, keys: list[str]) -> list[str]:
    return [name for name in rows.columns if name not in (*keys, "_arrival")]


def _last_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the last arrival."""
    names = _others(rows, keys)
    last = F.max_by(F.struct(*names), "_arrival")
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*keys, "_row.*")


def _last_values(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and column the last value there is, as loading the files in turn would leave it."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_arrival"))).alias(name)

    return rows.groupBy(*keys).agg(*(last(name) for name in _others(rows, keys)))


def landed_files(spark: SparkSession, landing: str) -> DataFrame:
    """Files in the datasets' folders (dataset, s3_path, modified), those without rows too.

    Names and times are listed; no content is read. A file of no bytes is not listed by Spark. Files in other folders are never looked at.
    """
    found = None
    for dataset, prefix in PREFIXES.items():
        try:
            files = spark.read.format("binaryFile").load(f"{landing}/{prefix}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        files = files.select(
            F.lit(dataset).alias("dataset"), canonical_path("path").alias("s3_path"),
            F.col("modificationTime").alias("modified"),
        )
        found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], "dataset string, s3_path string, modified timestamp")
    return found


def _load_waiting(lake: Lake, waiting: dict[str, DataFrame], quarter: str, batch_files: int) -> list[str]:
    """Load paths (``s3_path``, ``modified``) of each dataset, oldest first; returns those left out."""
    left: list[str] = []
    for dataset, rows in waiting.items():
        ordered = written(rows.orderBy("modified", "s3_path"), "waiting").orderBy("modified", "s3_path")
        for batch in batched(ordered.toLocalIterator(), batch_files):
            paths = [row.s3_path for row in batch]
            bad = set(lake.load(dataset, paths, quarter))
            loaded = [(path,) for path in paths if path not in bad]
            lake.ledger.done(lake.spark.createDataFrame(loaded, "s3_path string"))
            left += sorted(bad)
        delete_scratch(ordered)
    if lake.ledger.tail() > TAIL:
        lake.ledger.compact()
    return left


def ingest(
    lake: Lake, arrivals: DataFrame, quarter: str = gold_layer.DEFAULT_QUARTER, batch_files: int = BATCH_FILES
) -> list[str]:
    """Load all arrivals (dataset, s3_path, modified) that are not done; returns what stays PENDING.

    Every arrival gets a ledger row first, also a file without any rows.
    """
    arrivals = written(arrivals.select("dataset", "s3_path", "modified"), "arrivals")
    lake.ledger.pending(arrivals)
    waiting = {}
    for dataset in DATASETS:
        here = arrivals.where(F.col("dataset") == dataset).groupBy("s3_path").agg(F.max("modified").alias("modified"))
        waiting[dataset] = here.join(lake.ledger.waiting(dataset), "s3_path", "left_semi")
    left = _load_waiting(lake, waiting, quarter, batch_files)
    delete_scratch(arrivals)
    return left


def retry(lake: Lake, quarter: str = gold_layer.DEFAULT_QUARTER, batch_files: int = BATCH_FILES) -> list[str]:
    """Load what is still PENDING from earlier batches; returns what stays so."""
    none = F.lit(None).cast("timestamp").alias("modified")
    waiting = {dataset: lake.ledger.waiting(dataset).select("s3_path", none) for dataset in DATASETS}
    return _load_waiting(lake, waiting, quarter, batch_files)


def run_ingest(
    lake: Lake, landing: str, quarter: str = gold_layer.DEFAULT_QUARTER, batch_files: int = BATCH_FILES
) -> list[str]:
    """Bring every file that has arrived below ``landing`` into the lake; returns what stays PENDING."""
    return ingest(lake, landed_files(lake.spark, landing), quarter, batch_files)


def _followed(lake: Lake, arrivals: DataFrame, name: str, quarter: str, batch_files: int):
    """Start a query that ingests a stream of arrivals; its checkpoint lies in the lake."""

    def one_batch(batch: DataFrame, _: int) -> None:
        ingest(lake, batch, quarter, batch_files)

    return (
        arrivals.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", f"{lake.path}/checkpoints/{name}")
        .trigger(availableNow=True)
        .start()
    )


def follow_events(
    lake: Lake, events: DataFrame, body: str = "body", quarter: str = gold_layer.DEFAULT_QUARTER,
    stores: dict[str, str] | None = None, batch_files: int = BATCH_FILES,
):
    """Ingest the files that a stream of arrival messages names, batch by batch.

    ``events`` has the JSON message in ``body`` and its time in ``arrived``. Messages of other
    folders are dropped. ``stores`` maps buckets to the paths that their objects are read
    from, where that is not ``s3://`` and the bucket's name.
    """
    routed = route_events(events, body)
    path = F.col("s3_path")
    for bucket, root in (stores or {}).items():
        inside = F.concat(F.lit(f"{root.rstrip('/')}/"), "key")
        path = F.when(F.col("bucket") == bucket, canonical_path(inside)).otherwise(path)
    arrivals = routed.select("dataset", path.alias("s3_path"), F.col("arrived").cast("timestamp").alias("modified"))
    return _followed(lake, arrivals, "events", quarter, batch_files)


def landing_stream(spark: SparkSession, landing: str, files_per_batch: int = BATCH_FILES) -> DataFrame:
    """Files that arrive in the datasets' folders, as a stream (dataset, s3_path, modified).

    Names and times only; no content is read. A name is seen once, whatever happens to its content later.
    """
    found = None
    for dataset, prefix in PREFIXES.items():
        files = (
            spark.readStream.format("binaryFile").schema(_BINARY_FILE)
            .option("maxFilesPerTrigger", files_per_batch)
            .load(f"{landing}/{prefix}")
            .select(
                F.lit(dataset).alias("dataset"), canonical_path("path").alias("s3_path"),
                F.col("modificationTime").alias("modified"),
            )
        )
        found = files if found is None else found.unionByName(files)
    return found


def follow_landing(
    lake: Lake, landing: str, quarter: str = gold_layer.DEFAULT_QUARTER, batch_files: int = BATCH_FILES
):
    """Ingest what has arrived in the datasets' folders since the last run, batch by batch."""
    return _followed(lake, landing_stream(lake.spark, landing, batch_files), "landing", quarter, batch_files)
