"""CSV scan: each file's own header decides the columns, every value is read as text."""

from __future__ import annotations

import csv as _csv
import io

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from strata.functions.names import require
from strata.sources.files import normal_path, row_position, scanned_path


def csv_layouts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, header, multiline) per file from one splittable line scan.

    A record can only span lines if some line holds an odd number of quotes; files without such a line can be
    read in parallel splits, the others must be read by one task each.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("at"), row_position().alias("pos"), F.col("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # A header sits in the first split of a file, so lines of other splits carry no text into the aggregation.
    candidate = (F.col("pos.block") == 0) & (F.trim(F.replace("value", F.lit("\ufeff"), F.lit(""))) != "")
    first = F.min(F.when(candidate, F.struct("pos", "value")))
    odd = F.when(F.col("value").contains('"') & (quotes % 2 == 1), True)
    # A set of one value at most: with it Spark aggregates by hash, where a minimum of texts alone would sort all lines.
    files = lines.groupBy("at").agg(first.alias("first"), (F.size(F.collect_set(odd)) > 0).alias("multiline"))
    return files.select(normal_path(scanned_path("at")).alias("path"), F.regexp_replace("first.value", "^\ufeff", "").alias("header"), "multiline")


def header_columns(header: str) -> list[str]:
    return next(_csv.reader(io.StringIO(header)), [])


def scan_csv(spark: SparkSession, paths: list[str] | str, columns: list[str]) -> DataFrame:
    """All rows of the files as text: `columns` plus `path` and `_row_pos`.

    A declared column that a file's header lacks is an error; other columns are dropped. Files are grouped by
    layout (header, embedded line breaks), so a lake with one layout is one scan.
    """
    layouts = csv_layouts(spark, paths)
    kinds = layouts.groupBy("header", "multiline").agg(F.min("path").alias("sample")).collect()
    scans = []
    for kind in kinds:
        members = paths
        if len(kinds) > 1:
            same = F.col("header").eqNullSafe(kind["header"]) & (F.col("multiline") == kind["multiline"])
            members = [r["path"] for r in layouts.filter(same).select("path").collect()]
        scans.append(_scan_layout(spark, kind["header"] or "", kind["multiline"], members, columns, kind["sample"]))
    if not scans:
        schema = ", ".join(["path string", *[f"`{c}` string" for c in columns], "_row_pos struct<block bigint, row bigint>"])
        return spark.createDataFrame([], schema)
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out


def _scan_layout(spark, header: str, multiline: bool, paths, columns: list[str], sample: str) -> DataFrame:
    names = header_columns(header)
    absent = sorted(set(columns) - set(names))
    require(not absent, f"columns missing from {sample}: {absent}")
    # A repeated header name keeps its last column, as a keyed reading of the row would.
    last = {name: i for i, name in enumerate(names)}
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    reader = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    )
    return reader.csv(paths).select(
        normal_path(scanned_path()).alias("path"),
        *[F.col(f"c{last[c]}").alias(c) for c in columns],
        row_position().alias("_row_pos"),
    )


def validate_payloads(spark: SparkSession, paths: list[str] | str, key_column: str) -> DataFrame:
    """(path, ok, rows, head): a reply counts as a table only if its header names the key column."""
    layouts = csv_layouts(spark, paths)
    names = F.transform(F.split("header", ","), lambda x: F.regexp_replace(x, '^"|"$', ""))
    judged = layouts.select(
        "path", "multiline",
        F.coalesce(F.array_contains(names, key_column), F.lit(False)).alias("ok"),
        F.col("header").alias("head"),
    )
    good = [r["path"] for r in judged.filter("ok").select("path").collect()]
    if not good:
        return judged.select("path", "ok", F.lit(None).cast("bigint").alias("rows"), "head")
    counted = scan_csv(spark, good, [key_column]).groupBy("path").agg(F.count("*").alias("rows"))
    rows = F.when(F.col("ok"), F.coalesce("rows", F.lit(0)))
    return judged.join(counted, "path", "left").select("path", "ok", rows.alias("rows"), "head")
