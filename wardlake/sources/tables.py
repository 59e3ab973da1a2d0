"""Stored Parquet tables that are replaced slice by slice.

A path that is being read is never overwritten. Changed slices (months, quarters, or the whole table)
are written to a folder of their own; one commit (``commits.py``) then makes them visible. A write
that dies before that leaves the table as it was. Several writers may work at once: whoever commits
later does so on top of the other's state, and a merge into a slice that has changed meanwhile is
computed again. ``expire`` removes what no kept commit refers to.

With ``buckets`` the rows of a slice are stored by a hash of their keys. A merge then reads the slices
as they lie: only the arriving rows are shuffled, to the buckets of the table. A merge of more rows than
that many tasks should hold shuffles both sides instead, into as many tasks as the rows need, and deals
the result out to the same files.

On a catalog with row-level operations, ``merge_into_catalog`` does the same work natively.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.operators.upsert import upsert
from wardlake.session import shuffles_cleaned
from wardlake.sources.commits import CommitLog, Folder

WHOLE = "all"
KEEP = 10  # commits that expiry leaves
KEEP_SECONDS = 7 * 86400.0
HOLD_SECONDS = 86400.0
BUCKET_ROWS = 250_000  # rows of all touched slices that one task may merge as they lie


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form that lets the optimizer drop joins with it."""
    return spark.createDataFrame([], schema).limit(0)


def read_if_written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet folder, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def write_partitioned(
    df: DataFrame, path: str, folders: list[str], cluster_by: list[str] | None = None
) -> None:
    """Write one folder per value of ``folders``, its rows sorted by ``cluster_by``.

    Rebalancing brings the rows of a folder together (of a first cluster value where there are no folders),
    so that its files are as few as its rows allow, however many tasks write; with adaptive
    execution a value that holds far more rows than the rest is split over several tasks.
    """
    cluster_by = cluster_by or []
    together = folders or cluster_by[:1]
    if together:
        df = df.hint("rebalance", *(F.col(name) for name in together))
        df = df.sortWithinPartitions(*folders, *cluster_by)
    with shuffles_cleaned(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*folders).parquet(path)


@dataclass(frozen=True)
class LakeTable:
    """One stored table: where it is, its columns and how it is cut.

    ``slice_name`` and ``slice_of`` give the column that cuts the table into
    slices and the expression for it; without them the table is one slice. It cannot be a key in a
    table with buckets.
    ``cluster_by`` sorts the rows within a file, which lets a scan skip row groups.
    ``buckets`` deals the rows of a slice out by their keys, for merges without a shuffle of the
    table; choose as many as a slice fills files. ``partition_by`` adds folders below a slice instead.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    slice_name: str | None = None
    slice_of: Column | None = None
    slice_type: T.DataType = T.DateType()
    buckets: int = 0

    @property
    def commits(self) -> CommitLog:
        return CommitLog(self.spark, self.path)

    def current(self, number: int | None = None) -> dict[str, str]:
        """Folder of each slice, now or as of a commit; one entry per month or quarter."""
        state = self.commits.latest()[1] if number is None else self.commits.state(number)
        return state.get("slices", {})

    def _slice_folder(self, name: str, folder: str) -> str:
        path = f"{self.path}/data/{folder}"
        return path if name == WHOLE else f"{path}/{self.slice_name}={name}"

    def _stored_schema(self) -> T.StructType:
        fields = list(self.schema.fields)
        if self.slice_name and self.slice_name not in self.schema.names:
            fields.append(T.StructField(self.slice_name, self.slice_type))
        return T.StructType(fields)

    def read(self, slices: list[str] | None = None, number: int | None = None) -> DataFrame:
        """The visible rows, or those as of a commit, with the slice column for partition pruning."""
        return self.rows(self.current(number), slices)

    def rows(self, current: dict[str, str], slices: list[str] | None = None) -> DataFrame:
        """The rows of some slices (all by default) in the folders given for them."""
        schema = self._stored_schema()
        paths = [
            self._slice_folder(name, folder)
            for name, folder in sorted(current.items())
            if slices is None or name in slices
        ]
        if not paths:
            return empty(self.spark, schema)
        return (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.path}/data")
            .parquet(*paths)
            .select(*schema.names)
        )

    @contextmanager
    def held(self, seconds: float = HOLD_SECONDS) -> Iterator[DataFrame]:
        """The rows of now; their files stay until the end of the block, however long ``expire`` runs."""
        with self.commits.held(seconds) as number:
            yield self.read(number=number)

    def slices_of(self, df: DataFrame) -> list[str]:
        """Slices the rows belong to: calendar months or quarters, so few."""
        if self.slice_name is None:
            return [WHOLE]
        with shuffles_cleaned(self.spark):
            named = df.select(self.slice_of.cast("string").alias("slice")).distinct()
            return sorted(row["slice"] for row in named.collect())

    def _counted(self, df: DataFrame) -> dict[str, int]:
        """Rows of each slice."""
        if self.slice_name is None:
            return {WHOLE: df.count()}
        with shuffles_cleaned(self.spark):
            named = df.groupBy(self.slice_of.cast("string").alias("slice")).count()
            return {row["slice"]: row["count"] for row in named.collect()}

    def replace(self, df: DataFrame, slices: list[str], **noted: dict[str, str]) -> None:
        """Make ``df`` the whole content of the given slices.

        ``noted`` is kept in the commit, by slice.
        """
        if slices:
            folder = self._written(df)
            self.commits.commit(lambda _, state: self._after(state, slices, folder, noted))

    def _after(self, state: dict, slices: list[str], folder: str, noted: dict[str, dict] | None = None) -> dict:
        after = {**state, "slices": {**state.get("slices", {}), **dict.fromkeys(slices, folder)}}
        for name, values in (noted or {}).items():
            after[name] = {**state.get(name, {}), **values}
        return after

    def _written(self, df: DataFrame, deal: bool = False) -> str:
        """Write rows to a new folder, whose name nothing refers to yet.

        ``deal`` brings the rows of a bucket of a slice together first, which keeps its files few; one with
        far more rows than the rest is split over several tasks and files.
        """
        folder = f"write={uuid.uuid4().hex}"
        folders = list(self.partition_by)
        if self.slice_name:
            df = df.withColumn(self.slice_name, self.slice_of)
            folders = [self.slice_name, *folders]
        path = f"{self.path}/data/{folder}"
        if not self.buckets:
            write_partitioned(df, path, folders, list(self.cluster_by))
            return folder
        if deal:
            bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
            together = [F.col(each) for each in (*folders, "_bucket")]
            df = df.withColumn("_bucket", bucket).hint("rebalance", *together).drop("_bucket")
        # Files know their bucket by name; the catalog entry is only needed while writing.
        name = f"written_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, *self.keys)
        if self.cluster_by:
            writer = writer.sortBy(*self.cluster_by)
        if folders:
            writer = writer.partitionBy(*folders)
        with shuffles_cleaned(self.spark):
            writer.option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return folder

    def define(self, name: str, current: dict[str, str] | None = None, slices: list[str] | None = None) -> None:
        """Enter the table as it is now into the session's catalog, in place of an earlier entry.

        The entry is external: dropping it leaves the files. Every session of the catalog can read it.
        """
        current = self.current() if current is None else current
        run = self.spark.sql
        run(f"DROP TABLE IF EXISTS {name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._stored_schema())
        clauses = ["USING parquet"]
        if self.slice_name:
            clauses.append(f"PARTITIONED BY ({', '.join((self.slice_name, *self.partition_by))})")
        if self.buckets:
            clauses.append(f"CLUSTERED BY ({', '.join(self.keys)}) INTO {self.buckets} BUCKETS")
        if self.slice_name is None and WHOLE in current:
            clauses.append(f"LOCATION '{self._slice_folder(WHOLE, current[WHOLE])}'")
        else:
            clauses.append(f"LOCATION '{self.path}/data/nothing'")
        run(f"CREATE TABLE {name} ({columns}) {' '.join(clauses)}")
        chosen = sorted(s for s in current if s != WHOLE and (slices is None or s in slices))
        if chosen:
            parts = " ".join(
                f"PARTITION ({self.slice_name}='{s}') LOCATION '{self._slice_folder(s, current[s])}'" for s in chosen
            )
            run(f"ALTER TABLE {name} ADD {parts}")

    def merge(self, source: DataFrame, slices: list[str] | None = None, **rules) -> list[str]:
        """Upsert ``source``; only the slices its rows fall into are read and rewritten.

        Rows without a full key are left out, so that loading a file again changes nothing. Returns the
        slices; a caller that knows them can give them.
        """
        few = True
        if self.buckets:
            rows = self._counted(source.dropna(subset=list(self.keys)))
            slices = sorted(rows) if slices is None else slices
            few = sum(rows.values()) <= BUCKET_ROWS * self.buckets
        elif slices is None:
            slices = self.slices_of(source.dropna(subset=list(self.keys)))
        merged = self._merged if few else self._merged_anew
        if slices:
            self._rebuild(slices, lambda current: merged(current, slices, source, rules))
        return slices

    def append(self, build: Callable[[DataFrame], DataFrame]) -> None:
        """Add the rows that ``build`` derives from those there are, to a table of one slice."""

        def whole(current: dict[str, str]) -> str:
            rows = self.rows(current).select(*self.schema.names)
            return self._written(rows.unionByName(build(rows)))

        self._rebuild([WHOLE], whole)

    def _rebuild(self, slices: list[str], build: Callable[[dict[str, str]], str]) -> None:
        """Commit slices that ``build`` has written from the given state of the table."""
        made: dict[str, object] = {}

        def change(_: int, state: dict) -> dict:
            current = state.get("slices", {})
            read = {name: current.get(name) for name in slices}
            if made.get("read") != read:  # first, or another writer has replaced one of them
                made["folder"], made["read"] = build(current), read
            return self._after(state, slices, made["folder"])

        self.commits.commit(change)

    def _merged(self, current: dict[str, str], slices: list[str], source: DataFrame, rules: dict) -> str:
        target, most = self.rows(current, slices).select(*self.schema.names), BUCKET_ROWS * self.buckets
        if not self.buckets or target.count() > most:
            return self._merged_anew(current, slices, source, rules)
        if not set(slices) & set(current):
            return self._written(upsert(target, source, list(self.keys), on_null_key="reject",
                                        partitions=self.buckets, **rules))
        with self.in_buckets(current, slices) as target:
            return self._written(upsert(target, source, list(self.keys), on_null_key="reject",
                                        partitions=self.buckets, **rules))

    def _merged_anew(self, current: dict[str, str], slices: list[str], source: DataFrame, rules: dict) -> str:
        """Both sides shuffled, in as many tasks as their rows need."""
        target = self.rows(current, slices).select(*self.schema.names)
        return self._written(upsert(target, source, list(self.keys), on_null_key="reject", **rules), deal=True)

    @contextmanager
    def in_buckets(self, current: dict[str, str] | None = None, slices: list[str] | None = None) -> Iterator[DataFrame]:
        """The rows of some slices as they lie in their buckets."""
        name = f"slices_{uuid.uuid4().hex}"
        self.define(name, current, slices)
        try:
            yield self.spark.table(name).select(*self.schema.names)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def expire(self, keep: int = KEEP, seconds: float = KEEP_SECONDS) -> list[str]:
        """Delete files that no commit needs any more; returns the folders.

        The newest ``keep`` commits stay readable, those younger than ``seconds``, and those in a ``held``
        block. Folders younger than ``seconds`` stay too: their writer may not have committed yet.
        """
        used = set()
        for state in self.commits.expire(keep, seconds):
            for name, folder in state.get("slices", {}).items():
                used.add(folder if name == WHOLE else f"{folder}/{self.slice_name}={name}")
        data, gone = Folder(self.spark, f"{self.path}/data"), []
        for folder in data.names():
            if data.age(folder) < seconds:
                continue
            inner = [f"{folder}/{name}" for name in data.names(folder) if self.slice_name and name.startswith(f"{self.slice_name}=")]
            needed = folder in used or any(name in used for name in inner)
            for name in inner if needed else [folder]:
                if name not in used and not (name == folder and needed):
                    data.delete(name)
                    gone.append(name)
        return gone


def merge_into_catalog(
    table: str,
    source: DataFrame,
    keys: list[str],
    update: list[str] | None = None,
    keep_old_when_null: bool = False,
) -> None:
    """The same upsert as one native MERGE, for catalogs whose tables allow it.

    Unverified: no catalog with row-level operations was at hand; only its refusal by other tables
    is tested.
    """
    names = source.columns
    matched = {}
    for name in update or [name for name in names if name not in keys]:
        arriving = F.col(f"s.{name}")
        matched[name] = F.coalesce(arriving, F.col(f"{table}.{name}")) if keep_old_when_null else arriving
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"{table}.{key}") == F.col(f"s.{key}"))
    (
        source.alias("s")
        .mergeInto(table, condition)
        .whenMatched()
        .update(matched)
        .whenNotMatched()
        .insert({name: F.col(f"s.{name}") for name in names})
        .merge()
    )
