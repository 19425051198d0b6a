"""The stored manifest: which raw files a warehouse has taken in, with their provenance, and how far each folder was looked through.

Two tables of the warehouse itself: `_lake.files`, keyed by path and stored by day, and `_lake.folders`, with the time of change that a day's folder
had when it was last listed. A day whose folder has not changed since is neither listed nor are its sidecars opened; the manifest's rows of other
days are not read either. Files enter the manifest in the commit that publishes their rows, so neither can be there without the other.

A folder whose time of change is unknown, or so young that a file might still land at that same time, is listed again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.plans.registry import Dataset
from strata.plans.warehouse import OWN, Load, Warehouse
from strata.session import write_scratch
from strata.sources.files import RAW_COLUMNS
from strata.sources.raw import PROVENANCE, provenance, register_raw

FILES, FOLDERS = f"{OWN}files", f"{OWN}folders"
KEY = ("raw_path", *RAW_COLUMNS[:3])
_DAY = ("source", "dataset", "fetch_date")
#: Seconds that a folder's last change must lie back before its mark is believed.
SETTLED_S = 2.0
_MARKS = "source string, dataset string, fetch_date string, changed double"


def day_part(source: str = "source", dataset: str = "dataset", fetch_date: str = "fetch_date") -> str:
    return f"concat_ws('.', {source}, {dataset}, {fetch_date})"


@dataclass(frozen=True)
class Landed:
    """What has landed since the marks: new files with their provenance, and the marks to set once they are taken in."""

    files: DataFrame
    marks: dict[str, float]


def marks(warehouse: Warehouse, dataset: Dataset) -> dict[str, float]:
    """Time of change of each of the dataset's day folders when it was last listed; one row per day."""
    if not warehouse.exists(FOLDERS):
        return {}
    rows = warehouse.table(FOLDERS).filter((F.col("source") == dataset.source) & (F.col("dataset") == dataset.name))
    return {r["fetch_date"]: r["changed"] for r in rows.select("fetch_date", "changed").collect()}


def known_files(warehouse: Warehouse, dataset: Dataset | None = None, days: list[str] | None = None) -> DataFrame:
    """The manifest, or its rows of a dataset or of some of its days; only these days' parts are read."""
    state = warehouse.state(FILES)
    if state is None:
        return warehouse.spark.createDataFrame([], PROVENANCE)
    wanted = None if days is None else {f"{dataset.source}.{dataset.name}.{d}" for d in days}
    folders = [f for f in state.folders if wanted is None or f.rpartition("=")[2] in wanted]
    rows = warehouse.parts_of(FILES, folders).withColumnRenamed("raw_path", "path").drop("_source_file")
    return rows if dataset is None else rows.filter((F.col("source") == dataset.source) & (F.col("dataset") == dataset.name))


def landed(spark: SparkSession, lake: str, warehouse: Warehouse, dataset: Dataset) -> Landed:
    """Files that the warehouse has not taken in, found by listing only the day folders that changed since their mark.

    A file that was taken in before must be what it was: raw files are never replaced.
    """
    home = f"{lake.rstrip('/')}/raw/{dataset.source}/{dataset.name}"
    now, before = time.time(), marks(warehouse, dataset)
    # The time of change is read before the folder is listed: what lands in between changes it again.
    there = {name: changed for name, changed in warehouse.log.files.names(home) if not name.startswith((".", "_"))}
    days = sorted(d for d, changed in there.items() if changed <= 0 or before.get(d) != changed)
    if not days:
        return Landed(spark.createDataFrame([], PROVENANCE), {})
    found = provenance(spark, lake, dataset.source, dataset.name, "{" + ",".join(days) + "}")
    known = known_files(warehouse, dataset, days).select("path", F.col("size_bytes").alias("size_before"))
    listed = write_scratch(found.join(known, "path", "left"), "landed")
    replaced = listed.filter("size_before <> size_bytes").select("path").first()
    if replaced:
        raise FileExistsError(f"already landed, raw files are never replaced: {replaced['path']}")
    settled = {d: there[d] for d in days if 0 < there[d] <= now - SETTLED_S}
    return Landed(listed.filter("size_before IS NULL").drop("size_before"), settled)


def registration(files: DataFrame) -> Load:
    """The manifest's part of a load that takes in these files; their day decides where their rows are stored."""
    return Load(FILES, stored(files).withColumn("_row_pos", F.lit(0)), KEY, part_by=day_part())


def stored(files: DataFrame) -> DataFrame:
    """As the manifest table holds them: `path` is a helper column elsewhere."""
    return files.withColumnRenamed("path", "raw_path")


def folder_marks(spark: SparkSession, dataset: Dataset, found: dict[str, float]) -> list[Load]:
    if not found:
        return []
    rows = spark.createDataFrame([(dataset.source, dataset.name, d, c, 0) for d, c in found.items()], f"{_MARKS}, _row_pos int")
    return [Load(FOLDERS, rows, _DAY, parts=1)]


def register(warehouse: Warehouse, files: DataFrame) -> int:
    """Enter files without loading them, write-once: a path that is already there is refused. Returns how many were entered."""
    rows = register_raw(files, known_files(warehouse).limit(0))
    taken = files.join(known_files(warehouse).select("path"), "path", "left_semi").select("path").first()
    if taken:
        raise FileExistsError(f"already landed, raw files are never replaced: {taken['path']}")
    return warehouse.upsert_all([registration(rows.select(*files.columns))])[0].new
