"""Ledger of ingested files: one row per arrival, PENDING until its chain is done.

The ledger is a snapshot and a tail. Entries (arrivals, and paths that are done) are appended to the
tail by the batch; ``compact`` turns both into a new snapshot. The snapshot has a folder per status and
day of arrival, so looking for work reads its PENDING rows only, and looking up arrivals only their days.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.schemas import FILE_ARRIVALS, FILE_FINISHES, FILE_LOG, FILE_SNAPSHOT
from wardlake.sources.commits import CommitLog, Folder
from wardlake.sources.tables import empty

PENDING = "PENDING"
DONE = "DONE"


def log_pending(arrivals: DataFrame, *also: str) -> DataFrame:
    """Ledger rows for arrivals given as (dataset, s3_path, first_seen_ts) and further columns."""
    return arrivals.select(
        "dataset", "s3_path", *also, F.col("first_seen_ts").cast("timestamp"),
        F.lit(PENDING).alias("status"),
        F.lit(None).cast("timestamp").alias("processed_ts"),
    )


def mark_done(log: DataFrame, finished: DataFrame, *also: str) -> DataFrame:
    """Ledger after the (s3_path, processed_ts) updates.

    An update reaches every row of its path that was there by then; of several
    updates the last one stands.
    """
    last = finished.groupBy("s3_path").agg(F.max("processed_ts").alias("_last"))
    reached = F.col("_last") >= F.col("first_seen_ts")
    return log.join(last, "s3_path", "left").select(
        "dataset", "s3_path", *also, "first_seen_ts",
        F.when(reached, F.lit(DONE)).otherwise(F.col("status")).alias("status"),
        F.when(reached, F.col("_last").cast("timestamp"))
        .otherwise(F.col("processed_ts"))
        .alias("processed_ts"),
    )


TAIL = 32  # entries after which a run compacts the ledger


@dataclass(frozen=True)
class FileLedger:
    """Stored ledger, to which several writers can add.

    An arrival is a path with the time its content is from, so a file that comes again under the
    same path is an arrival of its own. Entries are added by the batch, whatever its size.
    """

    spark: SparkSession
    path: str

    @property
    def commits(self) -> CommitLog:
        return CommitLog(self.spark, self.path)

    def _entries(self, state: dict, kind: str, schema) -> DataFrame:
        folders = [f"{self.path}/entries/{name}" for name in state.get(kind, [])]
        return self.spark.read.schema(schema).parquet(*folders) if folders else empty(self.spark, schema)

    def _snapshot(self, state: dict) -> DataFrame:
        """Rows of the snapshot, with their folders ``status`` and ``day``."""
        if not state.get("snapshot"):
            return empty(self.spark, FILE_SNAPSHOT)
        return self.spark.read.schema(FILE_SNAPSHOT).parquet(f"{self.path}/snapshots/{state['snapshot']}")

    def _log(self, state: dict, snapshot: DataFrame) -> DataFrame:
        """The given rows of the snapshot and the tail's arrivals, after the tail's finishes."""
        rows = log_pending(self._entries(state, "arrivals", FILE_ARRIVALS), "modified")
        rows = snapshot.select(*rows.columns).unionByName(rows)
        return mark_done(rows, self._entries(state, "finished", FILE_FINISHES), "modified")

    def arrivals(self) -> DataFrame:
        """The ledger, with the time that each arrival's content is from."""
        _, state = self.commits.latest()
        return self._log(state, self._snapshot(state))

    def read(self) -> DataFrame:
        return self.arrivals().select(*FILE_LOG.names)

    def _append(self, kind: str, entries: DataFrame) -> None:
        folder = uuid.uuid4().hex
        entries.write.parquet(f"{self.path}/entries/{folder}")
        self.commits.commit(lambda _, state: {**state, kind: [*state.get(kind, []), folder]})

    def _known(self, state: dict, arrivals: DataFrame) -> DataFrame:
        """Arrivals in the ledger from the days of the given ones."""
        known = self._entries(state, "arrivals", FILE_ARRIVALS).select("s3_path", "modified")
        if not state.get("snapshot"):
            return known
        # Calendar days of what arrives: few, and the only folders read.
        days = [row.day for row in arrivals.select(F.to_date("modified").alias("day")).distinct().collect()]
        same = self._snapshot(state).where(F.col("day").isin(days))
        return known.unionByName(same.select("s3_path", "modified"))

    def pending(self, arrivals: DataFrame) -> None:
        """Log those (dataset, s3_path, modified) that are not in the ledger yet."""
        arrivals = arrivals.select("dataset", "s3_path", "modified").distinct()
        made: dict[str, object] = {}

        def change(_: int, state: dict) -> dict:
            read = (state.get("snapshot"), state.get("arrivals"))
            if made.get("read") != read:  # first, or another writer has added some
                new = arrivals.join(self._known(state, arrivals), ["s3_path", "modified"], "left_anti")
                made["folder"], made["read"] = uuid.uuid4().hex, read
                stamped = new.withColumn("first_seen_ts", F.current_timestamp()).select(*FILE_ARRIVALS.names)
                stamped.write.parquet(f"{self.path}/entries/{made['folder']}")
            return {**state, "arrivals": [*state.get("arrivals", []), made["folder"]]}

        self.commits.commit(change)

    def waiting(self, dataset: str) -> DataFrame:
        """Paths of the dataset with an arrival that is still PENDING."""
        _, state = self.commits.latest()
        open_ones = self._snapshot(state).where(F.col("status") == PENDING)
        log = self._log(state, open_ones).where((F.col("dataset") == dataset) & (F.col("status") == PENDING))
        return log.select("s3_path").distinct()

    def done(self, paths: DataFrame) -> None:
        """Mark all arrivals of the given paths (``s3_path``) that the ledger has so far."""
        stamped = paths.select("s3_path").withColumn("processed_ts", F.current_timestamp())
        self._append("finished", stamped)

    def tail(self) -> int:
        """Entries since the last compaction."""
        _, state = self.commits.latest()
        return len(state.get("arrivals", [])) + len(state.get("finished", []))

    def compact(self) -> None:
        """Make a snapshot of the ledger as it is; entries added meanwhile stay in the tail.

        If another writer compacts at the same time, the one that comes second leaves things as they are.
        """
        _, before = self.commits.latest()
        folder = uuid.uuid4().hex
        rows = self._log(before, self._snapshot(before)).withColumn("day", F.to_date("modified"))
        rows = rows.select(*FILE_SNAPSHOT.names).hint("rebalance", F.col("status"), F.col("day"))
        rows.write.partitionBy("status", "day").parquet(f"{self.path}/snapshots/{folder}")

        def change(_: int, state: dict) -> dict | None:
            if state.get("snapshot") != before.get("snapshot"):
                return None
            return {
                "snapshot": folder,
                **{kind: [name for name in state.get(kind, []) if name not in before.get(kind, [])]
                   for kind in ("arrivals", "finished")},
            }

        self.commits.commit(change)

    def expire(self, keep: int = 2, seconds: float = 86400.0) -> None:
        """Delete snapshots and entries that no kept commit needs."""
        left = self.commits.expire(keep, seconds)
        needed = {
            "snapshots": {state.get("snapshot") for state in left},
            "entries": {name for state in left for kind in ("arrivals", "finished") for name in state.get(kind, [])},
        }
        for below, names in needed.items():
            folder = Folder(self.spark, f"{self.path}/{below}")
            for name in folder.names():
                if name not in names and folder.age(name) >= seconds:
                    folder.delete(name)
