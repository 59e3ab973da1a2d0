"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffles, picks broadcast joins from measured sizes
# and splits skewed partitions, so no partition count is fixed here.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpointed frames go once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "wardlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="wardlake-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_CLEANING: dict[str, tuple[int, str]] = {}  # by session: blocks that are open, and the setting before them


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of a query when it ends, where it can do so.

    For queries whose result is read from files, or just once: nothing asks for their shuffles again. What is
    collected has to be built in the block too, what is written has not. Blocks of several threads may overlap.
    """
    if not spark.conf.isModifiable(_CLEANUP):
        yield
        return
    session = spark._jsparkSession.sessionUUID()
    with _LOCK:
        blocks, before = _CLEANING.get(session, (0, spark.conf.get(_CLEANUP)))
        _CLEANING[session] = (blocks + 1, before)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            blocks, before = _CLEANING.pop(session)
            if blocks > 1:
                _CLEANING[session] = (blocks - 1, before)
            else:
                spark.conf.set(_CLEANUP, before)


def delete_scratch(df: DataFrame) -> None:
    """Remove the files of a frame that ``written`` has returned."""
    spark = df.sparkSession
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, purpose)
    with shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

