"""Parquet scans of the clean layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.sources.files import normal_path, scanned_path


def scan_clean(spark: SparkSession, paths: list[str] | str, base_path: str | None = None) -> DataFrame:
    """The rows plus `_file_row` (position in the file) and `_file_name`."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("basePath", base_path) if base_path else spark.read
    df = reader.parquet(*paths)
    return df.select(
        "*", F.col("_metadata.row_index").alias("_file_row"),
        F.element_at(F.split(normal_path(scanned_path()), "/"), -1).alias("_file_name"),
    )


def parquet_glob(glob: str) -> str:
    """The SQL name of all Parquet files a glob matches."""
    if "`" in glob:
        raise ValueError("a glob cannot hold a back-tick")
    return f"parquet.`{glob}`"
