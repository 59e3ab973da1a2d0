"""Raw CSV files as all-string frames that remember the file each row came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlake.schemas import BRONZE_PBJ, BRONZE_PROVIDERINFO

SOURCE_PATH = "source_path"

# Names the raw tables are known by.
BRONZE_VIEWS = {
    "pbj": "bronze_pbj_daily_nurse_staffing_q2_2024_csv",
    "providerinfo": "bronze_nh_providerinfo_oct2024_csv",
}
DATASETS = {"pbj": BRONZE_PBJ, "providerinfo": BRONZE_PROVIDERINFO}


def csv_options(escape: str = "\\") -> dict[str, str]:
    return {"header": "true", "sep": ",", "quote": '"', "escape": escape}


def canonical_path(path: Column | str, encoded: bool = False) -> Column:
    """One spelling of a file's path for events, listings and readers.

    Readers give the path of a row's file ``encoded`` as a URI (``a%20b.csv``), the others plainly.
    Local files are written with one slash and all S3 schemes alike.
    """
    column = F.col(path) if isinstance(path, str) else path
    if encoded:
        column = F.url_decode(F.replace(column, F.lit("+"), F.lit("%2B")))
    column = F.regexp_replace(column, "^file:/+", "file:/")
    return F.regexp_replace(column, "^s3[an]://", "s3://")


def with_source_path(df: DataFrame) -> DataFrame:
    return df.select("*", canonical_path("_metadata.file_path", encoded=True).alias(SOURCE_PATH))


def from_file(bronze: DataFrame, source_path: str | list[str] | None) -> DataFrame:
    """Rows of one source file, or of the files that one delivery came in; all rows when no path is given."""
    if source_path is None:
        return bronze
    paths = [source_path] if isinstance(source_path, str) else source_path
    return bronze.where(F.col(SOURCE_PATH).isin([canonical_path(F.lit(path)) for path in paths]))


def _read(spark: SparkSession, path: str, schema: StructType, escape: str) -> DataFrame:
    return with_source_path(spark.read.schema(schema).options(**csv_options(escape)).csv(path))


def read_bronze_pbj(spark: SparkSession, path: str, escape: str = "\\") -> DataFrame:
    return _read(spark, path, BRONZE_PBJ, escape)


def read_bronze_providerinfo(spark: SparkSession, path: str, escape: str = "\\") -> DataFrame:
    return _read(spark, path, BRONZE_PROVIDERINFO, escape)


def register_bronze(spark: SparkSession, folders: dict[str, str], escape: str = "\\") -> None:
    """Make raw folders, given by dataset, available to ``spark.sql``; replaces earlier ones."""
    for dataset, path in folders.items():
        _read(spark, path, DATASETS[dataset], escape).createOrReplaceTempView(BRONZE_VIEWS[dataset])
