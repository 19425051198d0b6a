import random
import re

import pytest

from strata.operators.sets import compare_tables
from strata.plans.ingest import clean_files, compare_warehouses, ingest_files, ingest_incremental, new_files, rebuild
from strata.plans.incremental import overall, refresh
from strata.plans.manifest import known_files
from strata.plans.registry import DATASETS, GAP_EVENTS, NEARBY_STARS, Dataset, registry_frame
from strata.plans.warehouse import Warehouse
from strata.streaming.ingest import ingest_stream
from tests.conftest import gaps, stars_csv

STARS = {7: 301.5, 8: 44.25, 9: 120.0}


def history(lake, seed=5, files=5):
    """Files of gap events whose names are in no order of time; returns vessel -> hours after the last fetch, in plain Python."""
    rng = random.Random(seed)
    fetched = [(rng.choice("qdmx") + f"{n}.json", rng.randrange(1, 5000), [(rng.choice("KLMN"), "2023-05-04", rng.randrange(1, 99)) for _ in range(4)])
               for n in range(files)]
    truth = {}
    for name, minutes, rows in sorted(fetched, key=lambda f: f[1]):
        lake.land("gfw", "gap-events", name, gaps(*rows), minutes)
        truth |= {vessel: float(hours) for vessel, _, hours in rows}
    lake.land("gaia", "nearby-stars", "shell.csv", stars_csv(*STARS.items()), 7)
    return truth


def take_in_backwards(spark, lake, warehouse):
    """One load per file, newest first, which must not matter."""
    for dataset in (GAP_EVENTS, NEARBY_STARS):
        files = new_files(spark, str(lake), warehouse, dataset)
        for row in files.orderBy(files.fetched_at.desc()).collect():
            ingest_files(spark, str(lake), warehouse, dataset, files.filter(files.path == row["path"]))


def gap_hours(wh):
    return {r["vessel_id"]: r["duration_hours"] for r in wh.table("ocean.gap_events").collect()}


@pytest.mark.parametrize("seed", [5, 6])
def test_rebuild_and_loads_in_any_order_agree_with_plain_python(spark, lake, warehouse, tmp_path, seed):
    truth = history(lake, seed)
    stamp = {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in (lake.root / "raw").rglob("*.*")}
    take_in_backwards(spark, lake, warehouse)
    fresh = Warehouse(spark, str(tmp_path / "second"), catalog=False)
    report = rebuild(spark, str(lake), fresh)
    assert report.files == 6 and report.tables == {"ocean.gap_events": len(truth), "astro.nearby_stars": 3}
    assert gap_hours(warehouse) == gap_hours(fresh) == truth
    assert {r["source_id"]: r["parallax"] for r in fresh.table("astro.nearby_stars").collect()} == STARS
    compared = compare_warehouses(warehouse, fresh)
    assert compared.count() == 2 and compared.filter("NOT same").count() == 0
    assert stamp == {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in (lake.root / "raw").rglob("*.*")}


def test_a_second_ingest_reads_only_its_own_days(spark, lake, warehouse):
    lake.land("gfw", "gap-events", "old.json", gaps(("K", "2023-01-02", 3)), 0, day="2023-01-02")
    ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    lake.land("gfw", "gap-events", "new.json", gaps(("L", "2023-01-03", 4)), 60, day="2023-01-03")
    rows = clean_files(spark, str(lake), GAP_EVENTS, new_files(spark, str(lake), warehouse, GAP_EVENTS))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*2023-01-03", plan) and not re.search(r"PartitionFilters: \[[^\]]*2023-01-02", plan)
    assert [r["vessel_id"] for r in rows.collect()] == ["L"]


def test_rebuild_skips_the_unknown_and_protects_what_exists(spark, lake, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"), catalog=False)
    assert rebuild(spark, str(lake), wh).files == 0 and wh.tables() == []
    history(lake)
    lake.land("mystery", "things", "m.bin", b"x")
    for side in (lake.root / "raw").rglob("*.meta.json"):
        side.unlink()
    report = rebuild(spark, str(lake), wh)
    assert report.files == 6 and len(report.skipped) == 1 and "mystery" in report.skipped[0]
    with pytest.raises(FileExistsError):
        rebuild(spark, str(lake), wh)
    wh.load_table(spark.range(3), "old", "extra")
    rebuild(spark, str(lake), wh, replace=True)
    assert wh.tables() == ["astro.nearby_stars", "ocean.gap_events"]


def test_a_broken_file_leaves_the_warehouse_as_it_was(spark, lake, tmp_path):
    history(lake)
    wh = Warehouse(spark, str(tmp_path / "wh"), catalog=False)
    rebuild(spark, str(lake), wh)
    version = wh.state("astro.nearby_stars").version
    lake.land("gaia", "nearby-stars", "broken.csv", "nothing,useful\n1,2\n", 200)
    with pytest.raises(RuntimeError, match="gaia/nearby-stars.*broken.csv"):
        rebuild(spark, str(lake), wh, replace=True)
    assert wh.state("astro.nearby_stars").version == version and wh.table("astro.nearby_stars").count() == 3


def test_incremental_takes_each_file_once_and_overlap_is_harmless(spark, lake, warehouse):
    lake.land("gfw", "gap-events", "w1.json", gaps(("A", "2022-01-05", 10), ("B", "2022-02-05", "x")), 0)
    r = ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    assert (r.files, r.complete, r.upsert.new, r.bad_values) == (1, True, 2, {"duration_hours": 1})
    assert ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS).files == 0
    lake.land("gfw", "gap-events", "w2.json", gaps(("B", "2022-02-05", 25), ("C", "2022-03-10", 30)), 60, complete=False)
    r = ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    assert (r.files, r.complete, r.upsert.new, r.upsert.updated, r.upsert.total) == (1, False, 1, 1, 3)


def test_stream_ingest_equals_rebuild_even_with_late_files(spark, lake, warehouse, tmp_path):
    truth = history(lake)
    point = str(tmp_path / "cp")
    seen = []
    ingest_stream(spark, str(lake), warehouse, GAP_EVENTS, point, max_files=2, on_batch=lambda i, r: seen.append(r.files)).awaitTermination()
    assert sum(seen) == 5 and gap_hours(warehouse) == truth
    # Landed last, fetched first: only the vessel nobody else named comes from it.
    lake.land("gfw", "gap-events", "late.json", gaps(*[(v, "2023-05-04", 0.5) for v in [*truth, "Z"]]), 0)
    ingest_stream(spark, str(lake), warehouse, GAP_EVENTS, point).awaitTermination()
    assert gap_hours(warehouse) == {**truth, "Z": 0.5}
    fresh = Warehouse(spark, str(tmp_path / "second"), catalog=False)
    rebuild(spark, str(lake), fresh, datasets={("gfw", "gap-events"): GAP_EVENTS})
    assert compare_tables(warehouse.table("ocean.gap_events"), fresh.table("ocean.gap_events"), multiset=True).first()["same"]


PLANETS_CSV = ("pl_name,hostname,gaia_dr3_id,sy_dist,sy_plx,sy_gaiamag,sy_pnum,disc_year,discoverymethod,pl_orbper,pl_bmasse,pl_rade\n"
               "P b,Star A,Gaia DR3 1,1.30,769.0,9.5,1,2016,Radial Velocity,{orbit},1.3,1.1\n")


def test_refresh_reports_every_step(spark, lake, warehouse):
    lake.land("exoplanets", "planets", "p1.csv", PLANETS_CSV.format(orbit="11.2"), 0, complete=True, expected_rows=1)
    lake.land("exoplanets", "host-positions", "q.csv", "pl_name,hostname,ra,dec\nP b,Star A,1.0,2.0\n", 0, complete=True)
    steps = {r["step"]: (r["ok"], r["severity"]) for r in refresh(spark, str(lake), warehouse).collect()}
    assert steps == {"planets": (True, 0), "host-positions": (True, 0), "quality": (True, 0)}
    again = refresh(spark, str(lake), warehouse)
    assert [r["note"].startswith("already") for r in again.collect()] == [True, True, False] and overall(again).first()[0] == 0
    lake.land("exoplanets", "planets", "p2.csv", PLANETS_CSV.format(orbit="-1"), 60, complete=True)
    assert overall(refresh(spark, str(lake), warehouse)).first()[0] == 1
    lake.land("exoplanets", "planets", "p3.csv", PLANETS_CSV.format(orbit="3"), 120, complete=False)
    lake.land("exoplanets", "host-positions", "bad.csv", "<error/>\n", 120)
    steps = {r["step"]: (r["ok"], r["severity"]) for r in refresh(spark, str(lake), warehouse).collect()}
    assert steps == {"planets": (False, 2), "host-positions": (False, 2), "quality": (True, 0)}


def test_registry(spark):
    assert registry_frame(spark).count() == len(DATASETS) == 5
    with pytest.raises(ValueError, match="key columns"):
        Dataset("s", "d", "csv", {"a": "int"}, ("b",), "x.y")
    with pytest.raises(ValueError, match="unknown column types"):
        Dataset("s", "d", "csv", {"a": "decimal"}, ("a",), "x.y")


def test_of_files_fetched_together_the_last_path_wins_by_its_place(spark, lake, warehouse):
    """Rows are sorted by their file's place among the paths, not by the path; names sort as text."""
    for name, hours in (("9.json", 9), ("10.json", 10), ("a.json", 3), ("Z.json", 4)):
        lake.land("gfw", "gap-events", name, gaps(("K", "2023-01-02", hours), (name, "2023-01-02", hours)), 5)
    ingest_incremental(spark, str(lake), warehouse, GAP_EVENTS)
    assert gap_hours(warehouse) == {"K": 3.0, "9.json": 9.0, "10.json": 10.0, "a.json": 3.0, "Z.json": 4.0}
    rows = clean_files(spark, str(lake), GAP_EVENTS, known_files(warehouse, GAP_EVENTS))
    assert dict(rows.select("raw_file", "_file").distinct().collect()) == {"10.json": 1, "9.json": 2, "Z.json": 3, "a.json": 4}
