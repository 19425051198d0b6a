"""The stored manifest, and the report taken while rows are written."""

import os
import time

import pytest
from pyspark.sql import functions as F

from strata.operators import cleaning
from strata.plans import ingest, manifest
from strata.plans.ingest import ingest_files, ingest_incremental, new_files, rebuild
from strata.plans.registry import GAP_EVENTS, NEARBY_STARS
from strata.plans.warehouse import Warehouse
from tests.conftest import gaps, stars_csv


def land(lake, name, day, *rows, minutes=0, age=60):
    """A file of a day whose folder last changed `age` seconds ago."""
    path = lake.land("gfw", "gap-events", name, gaps(*rows), minutes, day=day)
    then = time.time() - age
    os.utime(path.parent, (then, then))
    return path


@pytest.fixture
def opened(monkeypatch):
    """Days whose folders are listed and whose sidecars are opened."""
    seen = []
    real = manifest.provenance
    monkeypatch.setattr(manifest, "provenance", lambda spark, lake, source, dataset, date: seen.append(date) or real(spark, lake, source, dataset, date))
    return seen


def test_a_second_ingest_opens_no_old_sidecar(spark, lake, warehouse, opened):
    land(lake, "a.json", "2023-01-01", ("K", "2023-01-01", 1))
    land(lake, "b.json", "2023-01-02", ("L", "2023-01-02", 2), age=50)
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 2 and opened == ["{2023-01-01,2023-01-02}"]
    assert manifest.known_files(warehouse, GAP_EVENTS).count() == 2
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 0 and len(opened) == 1
    land(lake, "c.json", "2023-01-03", ("M", "2023-01-03", 3), age=40)
    land(lake, "late.json", "2023-01-02", ("N", "2023-01-02", 4), minutes=5, age=30)
    report = ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    assert report.files == 2 and report.upsert.total == 4 and opened[1:] == ["{2023-01-02,2023-01-03}"]
    assert {r["filename"] for r in manifest.known_files(warehouse, GAP_EVENTS, ["2023-01-02"]).collect()} == {"b.json", "late.json"}
    plan = manifest.known_files(warehouse, GAP_EVENTS, ["2023-01-02"])
    assert all("2023-01-02" in f for f in plan.inputFiles())
    assert warehouse.tables() == ["ocean.gap_events"]  # bookkeeping is not a table of the user


def test_a_folder_that_just_changed_is_listed_again(spark, lake, warehouse, opened):
    land(lake, "a.json", "2023-01-01", ("K", "2023-01-01", 1), age=0)
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 1
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 0 and len(opened) == 2
    land(lake, "b.json", "2023-01-01", ("L", "2023-01-01", 1), age=60)
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 1
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 0 and len(opened) == 3


def test_files_are_write_once(spark, lake, warehouse):
    path = land(lake, "a.json", "2023-01-01", ("K", "2023-01-01", 1))
    ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    with pytest.raises(FileExistsError, match="never replaced"):
        manifest.register(warehouse, manifest.known_files(warehouse))
    path.write_text(path.read_text() + " ")
    land(lake, "b.json", "2023-01-01", ("L", "2023-01-01", 1), age=40)
    with pytest.raises(FileExistsError, match="a.json"):
        ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    lake.land("gaia", "nearby-stars", "s.csv", stars_csv((1, 2.0)))
    fresh = new_files(spark, str(lake), warehouse, NEARBY_STARS)
    assert manifest.register(warehouse, fresh) == 1 and new_files(spark, str(lake), warehouse, NEARBY_STARS).count() == 0


def test_a_load_that_fails_leaves_the_manifest_as_it_was(spark, lake, warehouse, monkeypatch):
    land(lake, "a.json", "2023-01-01", ("K", "2023-01-01", 1))
    commit = warehouse.log.commit

    def refuse(*args, **options):
        monkeypatch.setattr(warehouse.log, "commit", commit)
        raise OSError("no connection")

    monkeypatch.setattr(warehouse.log, "commit", refuse)
    with pytest.raises(OSError):
        ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    assert warehouse.tables() == [] and not warehouse.exists(manifest.FILES)
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 1
    # a batch that is loaded twice, as by a stream's retry, changes nothing
    again = ingest_files(spark, str(lake), warehouse, GAP_EVENTS, manifest.known_files(warehouse, GAP_EVENTS))
    assert (again.upsert.new, again.upsert.updated, again.upsert.total) == (0, 1, 1) and manifest.known_files(warehouse).count() == 1


def test_a_rebuilt_warehouse_knows_its_files(spark, lake, tmp_path):
    land(lake, "a.json", "2023-01-01", ("K", "2023-01-01", 1))
    lake.land("mystery", "things", "m.bin", b"x")
    wh = Warehouse(spark, str(tmp_path / "wh"), catalog=False)
    assert rebuild(spark, str(lake), wh).tables == {"ocean.gap_events": 1}
    assert [r["filename"] for r in manifest.known_files(wh).collect()] == ["a.json"]
    assert ingest_incremental(spark, str(lake), wh, GAP_EVENTS).files == 0


def test_a_row_lost_on_the_way_shows_in_the_report(spark, lake, warehouse, monkeypatch, tmp_path):
    schema = {"n": "int", "when": "timestamp"}
    text = [("1", "2024-01-01"), ("x", "never"), ("3", ""), ("4", "2024-01-02")]
    records = spark.createDataFrame([(f"/raw/s/d/2024-01-01/f{i % 2}.csv", *r, (0, i)) for i, r in enumerate(text)],
                                    "path string, n string, `when` string, _row_pos struct<block bigint, row bigint>").repartition(2)
    report = cleaning.write_clean_reported(records, lambda df: cleaning.clean(df, schema), schema, str(tmp_path), "s", "d")
    assert report == cleaning.CleanReport(4, 4, {"n": 1, "when": 1}) and report.whole
    lossy = cleaning.write_clean_reported(records, lambda df: cleaning.clean(df, schema).filter("n IS NULL OR n <> 3"), schema, str(tmp_path), "s", "d")
    assert (lossy.rows_in, lossy.rows_out, lossy.whole) == (4, 3, False)
    none = cleaning.write_clean_reported(records.limit(0), lambda df: cleaning.clean(df, schema), schema, str(tmp_path), "s", "e")
    assert none == cleaning.CleanReport(0, 0, {})
    land(lake, "a.json", "2023-01-01", ("K", "2023-01-01", 1), ("L", "2023-01-01", 1))
    real = ingest.typed
    monkeypatch.setattr(ingest, "typed", lambda d, df: real(d, df).filter(F.col("vessel_id") != "L"))
    with pytest.raises(RuntimeError, match="2 records read, 1 rows written"):
        ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    assert warehouse.tables() == []
