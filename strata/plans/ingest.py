"""Raw files -> clean layer -> curated tables: for new files, for one dataset, or for the whole lake."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strata.functions.names import require
from strata.operators.cleaning import CleanReport, clean, clean_json, lineage_name, read_clean, write_clean_reported
from strata.operators.sets import compare_tables, union_by_name
from strata.operators.windows import latest_wins
from strata.plans.manifest import FILES, KEY, day_part, folder_marks, landed, registration, stored
from strata.plans.registry import DATASETS, Dataset, registry_frame
from strata.plans.warehouse import Load, UpsertReport, Warehouse
from strata.session import write_scratch
from strata.sources.csv import scan_csv
from strata.sources.json import scan_json
from strata.sources.raw import provenance

_ORDER = ("_fetched_at", "_file", "_row_pos")


def scan_records(spark: SparkSession, dataset: Dataset, paths: list[str]) -> DataFrame:
    """Records of raw files of one dataset as they were received."""
    return scan_csv(spark, paths, list(dataset.schema)) if dataset.format == "csv" else scan_json(spark, paths)


def typed(dataset: Dataset, records: DataFrame) -> DataFrame:
    """Their typed rows, with `path`, `_row_pos` and `_bad`."""
    return clean(records, dataset.schema) if dataset.format == "csv" else clean_json(records, dataset.schema)


def clean_files(spark: SparkSession, lake: str, dataset: Dataset, manifest: DataFrame) -> DataFrame:
    """Clean the manifest's files into the clean layer and return their rows with fetch time and lineage."""
    return clean_and_report(spark, lake, dataset, manifest)[0]


def clean_and_report(spark: SparkSession, lake: str, dataset: Dataset, manifest: DataFrame) -> tuple[DataFrame, CleanReport]:
    """The rows of `clean_files`, and what was counted while they were written.

    The list of file names is the only thing the driver sees; it plans the scan from it.
    """
    # The manifest is written out, so joins with it know its real (small) size.
    files = write_scratch(manifest.select("path", "fetch_date", F.col("filename").alias("raw_file"), "size_bytes",
                                          F.col("fetched_at").alias("_fetched_at")), "manifest")
    listed = files.select("path", "size_bytes", "fetch_date").collect()
    hollow = [r["path"] for r in listed if not r["size_bytes"]]
    if hollow:
        raise ValueError(f"empty raw file, it has no header or list: {hollow[0]}")
    records = scan_records(spark, dataset, [r["path"] for r in listed])
    report = write_clean_reported(records, lambda df: typed(dataset, df), list(dataset.schema), lake, dataset.source, dataset.name)
    if not report.whole:
        raise RuntimeError(f"{dataset.source}/{dataset.name}: {report.rows_in} records read, {report.rows_out} rows written")
    rows = read_clean(spark, lake, dataset.source, dataset.name, dataset.spark_types())
    # Literal dates prune the clean layer to the batch's days; the join picks its files among these.
    rows = rows.filter(F.col("fetch_date").isin(sorted({r["fetch_date"] for r in listed})))
    # Names are derived once per file, not once per row; a file's place among the sorted paths stands for its path where rows are sorted.
    chosen = files.select("fetch_date", "raw_file", lineage_name(F.col("raw_file")).alias("_source_file"), "_fetched_at",
                          F.concat_ws("/", "fetch_date", "raw_file").alias("_path")).withColumn("_file", F.row_number().over(Window.orderBy("_path")))
    return rows.drop("_source_file").join(chosen, ["fetch_date", "raw_file"]), report


def _stored(dataset: Dataset, rows: DataFrame) -> DataFrame:
    return rows.select(*dataset.schema, "_source_file", "_fetched_at")


@dataclass
class RebuildReport:
    files: int = 0
    tables: dict[str, int] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)  # one note per unknown (source, dataset)


def rebuild(spark: SparkSession, lake: str, target: Warehouse, replace: bool = False, datasets=None) -> RebuildReport:
    """Recreate the clean layer and every curated table from raw files alone.

    Replaying files one by one, oldest fetch first, leaves the row with the greatest (fetch time, path, position)
    per key, so one latest-wins job per dataset gives the same tables. All tables are built beside the live ones
    and published together; an existing warehouse is only replaced if asked.
    """
    known = datasets or DATASETS
    files = write_scratch(provenance(spark, lake), "provenance")
    present = files.groupBy("source", "dataset").agg(F.count("*").alias("files"), F.min("path").alias("sample"), F.sum("size_bytes").alias("bytes"))
    report = RebuildReport()
    # One row per dataset folder.
    groups = {(r["source"], r["dataset"]): r for r in present.collect()}
    if not groups:
        return report
    if target.tables() and not replace:
        raise FileExistsError(f"{target.root} already holds tables; pass replace=True to swap in the rebuilt ones")
    unknown = present.join(registry_frame(spark, known), ["source", "dataset"], "left_anti").orderBy("source", "dataset").collect()
    report.skipped = [f"{r['sample']} and {r['files'] - 1} more (no dataset {r['source']}/{r['dataset']} known yet)" for r in unknown]
    frames = {}
    for pair, dataset in known.items():
        if pair not in groups:
            continue
        mine = files.filter((F.col("source") == pair[0]) & (F.col("dataset") == pair[1]))
        try:
            rows = clean_files(spark, lake, dataset, mine)
        except Exception as error:
            raise RuntimeError(f"rebuild failed on {pair[0]}/{pair[1]}: {error}") from error
        frames[dataset.table] = (_stored(dataset, latest_wins(rows, list(dataset.key), _ORDER)), dataset.key, dataset.part_by)
        report.files += groups[pair]["files"]
    # The rebuilt warehouse holds these files; the next ingest starts from there.
    listed = files.join(registry_frame(spark, known).select("source", "dataset"), ["source", "dataset"], "left_semi").select(*files.columns)
    frames[FILES] = (stored(listed), KEY, day_part())
    # About 256 MB of raw text per stored part of the largest dataset.
    largest = max((groups[pair]["bytes"] or 0 for pair in known if pair in groups), default=0)
    made = target.publish_all(frames, parts=max(8, largest // 268_435_456), drop_others=True)
    report.tables = {name: n for name, n in made.items() if name != FILES}
    return report


def compare_warehouses(a: Warehouse, b: Warehouse, tables: list[str] | None = None) -> DataFrame:
    """(table, rows_a, rows_b, only_a, only_b, same) for each table, to prove that a rebuilt warehouse equals the live one."""
    names = tables or a.tables()
    require(bool(names), "no tables to compare")
    rows = [compare_tables(a.table(n), b.table(n)).select(F.lit(n).alias("table"), "*") for n in names]
    return union_by_name(*rows)


@dataclass
class IngestReport:
    table: str
    files: int
    complete: bool  # every ingested file is known to be a complete fetch
    upsert: UpsertReport | None = None
    bad_values: dict[str, int] = field(default_factory=dict)


def new_files(spark: SparkSession, lake: str, warehouse: Warehouse, dataset: Dataset) -> DataFrame:
    """Manifest of the dataset's raw files that the warehouse has not taken in yet."""
    return landed(spark, lake, warehouse, dataset).files


def ingest_files(spark: SparkSession, lake: str, warehouse: Warehouse, dataset: Dataset, manifest: DataFrame, marks: dict[str, float] | None = None) -> IngestReport:
    """Clean the given raw files together and upsert them; their rows and their entries in the manifest are published in one step.

    Safe to repeat. Rows of an incomplete fetch are loaded as well; only the high-water mark ignores them. `marks` are set in the same step.
    """
    manifest = write_scratch(manifest, "ingest")
    facts = manifest.agg(F.count("*").alias("files"), F.coalesce(F.min("complete"), F.lit(True)).alias("complete")).first()
    if not facts["files"]:
        if marks:
            warehouse.upsert_all(folder_marks(spark, dataset, marks))
        return IngestReport(dataset.table, 0, True)
    rows, cleaned = clean_and_report(spark, lake, dataset, manifest)
    load = Load(dataset.table, rows.drop("fetch_date", "raw_file"), dataset.key, order=_ORDER, part_by=dataset.part_by)
    result = warehouse.upsert_all([load, registration(manifest), *folder_marks(spark, dataset, marks or {})])[0]
    return IngestReport(dataset.table, facts["files"], facts["complete"], result, cleaned.bad_values)


def ingest_incremental(spark: SparkSession, lake: str, warehouse: Warehouse, dataset: Dataset) -> IngestReport:
    """Take in whatever landed since last time; overlapping windows are harmless because of the upsert."""
    found = landed(spark, lake, warehouse, dataset)
    return ingest_files(spark, lake, warehouse, dataset, found.files, found.marks)
