"""Shared pieces of the file scans: path parts, row positions, missing folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

# Fixed layout: <lake>/raw/<source>/<dataset>/<date>/<file>
RAW_LAYOUT = r"/raw/([^/]+)/([^/]+)/([^/]+)/([^/]+)$"
SIDECAR_SUFFIX = ".meta.json"
RAW_COLUMNS = ("source", "dataset", "fetch_date", "filename")


def raw_glob(lake: str, source: str = "*", dataset: str = "*", date: str = "*", name: str = "*") -> str:
    return f"{lake.rstrip('/')}/raw/{source}/{dataset}/{date}/{name}"


def scanned_path(column: str = "_metadata.file_path") -> Column:
    """Path of the file a row came from, decoded. Evaluated per row, so the usual path passes through untouched."""
    path = F.col(column)
    return F.when(path.contains("%"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def normal_path(path: Column) -> Column:
    """One spelling per path, since listings and scans write local URIs differently.

    Scans spell local paths with one slash, so this runs for every row of a file: without a pattern match, which took as long as reading the row.
    """
    one = path.startswith("file:/") & ~path.startswith("file://")
    two = path.startswith("file://") & ~path.startswith("file:///")
    return (F.when(one, F.concat(F.lit("file://"), F.substr(path, F.lit(6))))
            .when(two, F.concat(F.lit("file:///"), F.substr(path, F.lit(8)))).otherwise(path))


def last_parts(path: str = "path") -> tuple[Column, Column]:
    """(date folder, file name) of a raw path, without a pattern match per row."""
    tail = F.substring_index(path, "/", -2)
    return F.substring_index(tail, "/", 1), F.substring_index(path, "/", -1)


def with_path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add source, dataset, fetch_date and filename, all read from the path."""
    parts = {name: F.regexp_extract(F.col(path), RAW_LAYOUT, i + 1) for i, name in enumerate(RAW_COLUMNS)}
    return df.withColumns(parts)


def row_position() -> Column:
    """Order of a row inside its file, also when the file is read in several splits.

    A split is one stretch of one file read by one task, so (split start, running id) sorts rows as written.
    """
    return F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def is_missing_path(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith("PATH_NOT_FOUND")
