"""Continuous raw-zone ingest: new files are found by a stream, cleaned and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strata.plans.ingest import ingest_files
from strata.plans.registry import Dataset
from strata.plans.warehouse import Warehouse
from strata.sources.files import SIDECAR_SUFFIX, normal_path, raw_glob, with_path_parts
from strata.sources.raw import provenance

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(spark: SparkSession, lake: str, warehouse: Warehouse, dataset: Dataset, checkpoint: str,
                  max_files: int = 1000, on_batch=None) -> StreamingQuery:
    """Start a stream that takes in every raw file not seen before and stops when none is left.

    The stream carries file names only; `max_files` per batch is the catch-up throttle. A batch that is retried after
    a lost executor repeats an upsert, which changes nothing. Rows keep their fetch time, so a file that lands late
    cannot replace a newer copy.
    """
    landed = (
        spark.readStream.format("binaryFile").schema(_FILE_SCHEMA).option("maxFilesPerTrigger", max_files)
        .load(raw_glob(lake, dataset.source, dataset.name)).select("path")
    )

    def take_in(batch: DataFrame, batch_id: int) -> None:
        names = with_path_parts(batch.select(normal_path(F.col("path")).alias("path"))).filter(
            ~F.col("path").endswith(SIDECAR_SUFFIX)).select("path", "fetch_date").distinct()
        # Only the date folders of this batch are listed again.
        dates = sorted(r["fetch_date"] for r in names.select("fetch_date").distinct().collect())
        if not dates:
            return
        there = provenance(batch.sparkSession, lake, dataset.source, dataset.name, "{" + ",".join(dates) + "}")
        manifest = there.join(names.select("path"), "path", "left_semi")
        report = ingest_files(batch.sparkSession, lake, warehouse, dataset, manifest)
        if on_batch:
            on_batch(batch_id, report)

    return (
        landed.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
