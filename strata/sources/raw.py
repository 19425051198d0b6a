"""Raw zone: listing, provenance, integrity, registration and completeness of landed files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.names import require
from strata.functions.parsing import blank_to_null, parse
from strata.functions.scalars import content_hash
from strata.session import write_scratch
from strata.sources.files import (
    RAW_COLUMNS, RAW_LAYOUT, SIDECAR_SUFFIX, is_missing_path, normal_path, raw_glob, scanned_path, with_path_parts,
)

# The largest file whose bytes fit into one cell of a Spark row; larger ones are hashed as a stream on an executor.
MAX_CONTENT_BYTES = 2_000_000_000
_BLOCK = 1 << 24


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256) of each path, read block by block, so memory does not depend on the file."""
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            system, at = fs.FileSystem.from_uri(quote(path, safe=":/"))
            digest = hashlib.sha256()
            with system.open_input_stream(at) as stream:
                while block := stream.read(_BLOCK):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "sha256"])

_LISTING = "path string, size_bytes bigint, content binary"


def _binary_files(spark: SparkSession, glob: str) -> DataFrame:
    try:
        files = spark.read.format("binaryFile").load(glob)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return spark.createDataFrame([], _LISTING)
    return files.select(normal_path(F.col("path")).alias("path"), F.col("length").alias("size_bytes"), "content")


def _data_files(spark: SparkSession, lake: str, source: str, dataset: str, date: str) -> DataFrame:
    files = _binary_files(spark, raw_glob(lake, source, dataset, date))
    is_data = F.col("path").rlike(RAW_LAYOUT) & ~F.col("path").endswith(SIDECAR_SUFFIX)
    return with_path_parts(files.filter(is_data)).filter(F.col("filename") != ".gitkeep")


def raw_files(spark: SparkSession, lake: str, source: str = "*", dataset: str = "*", date: str = "*") -> DataFrame:
    """Every landed data file: path, source, dataset, fetch_date, filename, size_bytes. File bytes are not read."""
    return _data_files(spark, lake, source, dataset, date).select("path", *RAW_COLUMNS, "size_bytes")


def sidecars(spark: SparkSession, lake: str, source: str = "*", dataset: str = "*", date: str = "*") -> DataFrame:
    """One row per sidecar: the data file it belongs to and its fields as a VARIANT (NULL if damaged)."""
    days = raw_glob(lake, source, dataset, date, "").rstrip("/")  # a day without sidecars is no error
    try:
        text = spark.read.text(days, wholetext=True, pathGlobFilter="*" + SIDECAR_SUFFIX).select(scanned_path().alias("_at"), "value")
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        text = spark.createDataFrame([], "_at string, value string")
    meta = F.try_parse_json("value")
    owner = F.regexp_replace(normal_path(F.col("_at")), r"\.meta\.json$", "")
    return text.select(
        owner.alias("path"),
        F.when(F.schema_of_variant(meta).startswith("OBJECT"), meta).alias("meta"),
    )


def _field(name: str, type_name: str) -> Column:
    return F.try_variant_get("meta", f"$.{name}", type_name)


def _complete_flag() -> Column:
    """No sidecar or no flag = complete. A damaged sidecar or an explicit null = not complete."""
    flag = F.variant_get("meta", "$.complete", "variant")
    kind = F.schema_of_variant(flag)
    as_text = _field("complete", "string")
    return (
        F.when(~F.col("has_sidecar"), True)
        .when(F.col("meta").isNull(), False)
        .when(flag.isNull(), True)
        .when(kind == "VOID", False)
        .when(kind == "BOOLEAN", as_text == "true")
        .when(kind == "STRING", as_text != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~as_text.isin("{}", "[]"))
        .otherwise(as_text.try_cast("double") != 0)
    )


#: Columns of `provenance`.
PROVENANCE = ("path string, source string, dataset string, fetch_date string, filename string, size_bytes bigint, has_sidecar boolean, fetched_at timestamp, "
              "complete boolean, rows bigint, pages bigint, expected_rows bigint, start_date date, end_date date, stated_size bigint, stated_sha256 string")


def provenance(spark: SparkSession, lake: str, source: str = "*", dataset: str = "*", date: str = "*") -> DataFrame:
    """Manifest: one row per raw file with what its sidecar says.

    `fetched_at` falls back to midnight UTC of the date folder, then to the earliest time.
    """
    meta = sidecars(spark, lake, source, dataset, date).withColumn("has_sidecar", F.lit(True))
    joined = raw_files(spark, lake, source, dataset, date).join(meta, "path", "left").withColumn(
        "has_sidecar", F.coalesce("has_sidecar", F.lit(False))
    )
    stated = parse(blank_to_null(_field("fetched_at_utc", "string")), "timestamp")
    folder_day = F.when(F.col("fetch_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat("fetch_date", F.lit("T00:00:00Z")))
    earliest = F.lit("0001-01-01T00:00:00Z").cast("timestamp")
    return joined.select(
        "path", *RAW_COLUMNS, "size_bytes", "has_sidecar",
        F.coalesce(stated, folder_day.try_cast("timestamp"), earliest).alias("fetched_at"),
        _complete_flag().alias("complete"),
        _field("rows", "bigint").alias("rows"),
        _field("pages", "bigint").alias("pages"),
        _field("expected_rows", "bigint").alias("expected_rows"),
        _field("start_date", "string").try_cast("date").alias("start_date"),
        _field("end_date", "string").try_cast("date").alias("end_date"),
        _field("size_bytes", "bigint").alias("stated_size"),
        _field("sha256", "string").alias("stated_sha256"),
    )


def verify_raw(spark: SparkSession, lake: str, source: str = "*", dataset: str = "*",
               manifest: DataFrame | None = None) -> DataFrame:
    """Recompute size and checksum of every raw file and compare with what was recorded at landing.

    status: ok, changed or no_sidecar. Files too large for a cell of a row are hashed as streams, to the same effect.
    `manifest` (path, stated_size, stated_sha256) replaces the sidecars when provenance is kept in a table.
    """
    files = _data_files(spark, lake, source, dataset, "*")
    hashed = files.filter(F.col("size_bytes") <= MAX_CONTENT_BYTES).select(
        "path", *RAW_COLUMNS, "size_bytes", content_hash("content").alias("sha256"))
    large = files.filter(F.col("size_bytes") > MAX_CONTENT_BYTES).select("path", *RAW_COLUMNS, "size_bytes")
    streamed = large.join(large.select("path").mapInArrow(_hash_streams, "path string, sha256 string"), "path")
    stated = (provenance(spark, lake, source, dataset) if manifest is None else manifest).select(
        "path", "stated_size", "stated_sha256")
    same_size = F.col("size_bytes").eqNullSafe(F.col("stated_size"))
    status = (
        F.when(F.col("stated_sha256").isNull(), "no_sidecar")
        .when(~same_size, "changed")
        .when(F.col("sha256") != F.col("stated_sha256"), "changed")
        .otherwise("ok")
    )
    return hashed.unionByName(streamed).join(stated, "path", "left").withColumn("status", status)


# Provenance fields that extra metadata may never replace.
CORE_FIELDS = ("source", "dataset", "filename", "fetched_at_utc", "size_bytes", "sha256")


def register_raw(new_files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest plus newly landed files; refuses any path that is already registered.

    `new_files` may carry an `extra` map<string,string>; its keys that clash with core fields are dropped.
    """
    require("path" in new_files.columns and "path" in manifest.columns, "both sides need a path column")
    taken = new_files.join(manifest.select("path"), "path", "left_semi").limit(1).collect()
    if taken:
        raise FileExistsError(f"already landed, raw files are never replaced: {taken[0]['path']}")
    repeated = new_files.groupBy("path").count().filter("count > 1").limit(1).collect()
    if repeated:
        raise FileExistsError(f"landed twice in one batch: {repeated[0]['path']}")
    if "extra" in new_files.columns:
        new_files = new_files.withColumn("extra", F.map_filter("extra", lambda k, _: ~k.isin(*CORE_FIELDS)))
    return manifest.unionByName(new_files)


def fetch_completeness(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, rows, complete, reason) per fetched file, from the received rows and what was promised.

    With `expected_rows` fewer rows mean incomplete and more are fine; with `row_limit` exactly the limit means
    there may be more; with neither the fetch cannot be shown to be complete.
    """
    counted = rows.groupBy("path").agg(F.count("*").alias("rows"))
    promised = manifest.select(
        "path",
        *[F.col(c).cast("bigint") if c in manifest.columns else F.lit(None).cast("bigint").alias(c)
          for c in ("expected_rows", "row_limit")],
    )
    got, expected, limit = F.col("rows"), F.col("expected_rows"), F.col("row_limit")
    reason = (
        F.when(expected.isNotNull() & (got < expected), "fewer_than_expected")
        .when(limit.isNotNull() & (got >= limit), "limit_reached")
        .when(expected.isNull() & limit.isNull(), "unverified")
        .otherwise("complete")
    )
    joined = promised.join(counted, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return joined.withColumn("reason", reason).select("path", "rows", (F.col("reason") == "complete").alias("complete"), "reason")


def page_audit(pages: DataFrame, fetch: str, page: str, rows: str, content: str, limit: int, cap: int) -> DataFrame:
    """(fetch, pages, rows_kept, complete, reason) of paged fetches, one input row per landed page.

    Pages count from 0 and all landed pages count, also beyond `cap`. The first empty, repeated or short page ends a fetch;
    a repeated page means the source ignores the offset, and a fetch that never ends but fills `cap` pages was cut off.
    """
    require(limit >= 1 and cap >= 1, "limit and cap must be 1 or more")
    p = pages.select(
        F.col(fetch).alias("fetch"), F.col(page).cast("bigint").alias("page"),
        F.col(rows).cast("bigint").alias("n"), F.col(content).alias("hash"))
    # The previous page is an equality join on (fetch, page), so one very long fetch still spreads over all tasks.
    before = p.select("fetch", (F.col("page") + 1).alias("page"), F.col("hash").alias("hash_before"))
    ending = (
        F.when(F.col("n") == 0, "empty")
        .when(F.col("hash") == F.col("hash_before"), "repeated")
        .when(F.col("n") < limit, "short")
    )
    judged = write_scratch(p.join(before, ["fetch", "page"], "left").select("fetch", "page", "n", ending.alias("ending")), "pages")
    last = judged.groupBy("fetch").agg(
        F.min(F.when(F.col("ending").isNotNull(), F.struct("page", "ending"))).alias("end"),
        F.max("page").alias("last_page"),
    )
    used = judged.join(last, "fetch").filter(F.col("end").isNull() | (F.col("page") <= F.col("end.page")))
    kept = F.when(F.col("ending").isin("empty", "repeated"), 0).otherwise(F.col("n"))
    reason = (
        F.when(F.col("ending").isin("empty", "short"), "complete")
        .when(F.col("ending") == "repeated", "offset_ignored")
        .when(F.col("last_page") >= cap - 1, "page_cap")
        .otherwise("cut_off")
    )
    return used.groupBy("fetch").agg(
        F.count("*").alias("pages"), F.sum(kept).alias("rows_kept"),
        F.max("end.ending").alias("ending"), F.max("last_page").alias("last_page"),
    ).select("fetch", "pages", "rows_kept", (reason == "complete").alias("complete"), reason.alias("reason"))
