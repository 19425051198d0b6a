"""JSON scan: a file is one list of records, each record becomes one VARIANT row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.sources.files import normal_path, scanned_path


def scan_json(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, _row_pos, record). A file that is not a list of objects fails the job and is named.

    A list is one JSON document, so parallelism is per file; land many files rather than one huge one.
    """
    files = spark.read.text(paths, wholetext=True).select(
        normal_path(scanned_path()).alias("path"),
        F.from_json("value", "array<variant>").alias("records"),
    )
    is_list = F.coalesce(F.expr("forall(records, x -> schema_of_variant(x) LIKE 'OBJECT%')"), F.lit(False))
    complaint = F.concat(F.lit("raw JSON must be a list of records (objects): "), F.col("path"))
    checked = files.filter(F.when(is_list, True).otherwise(F.raise_error(complaint).cast("boolean")))
    return checked.select("path", F.posexplode("records").alias("_pos", "record")).select(
        "path",
        F.struct(F.lit(0).cast("bigint").alias("block"), F.col("_pos").cast("bigint").alias("row")).alias("_row_pos"),
        "record",
    )
