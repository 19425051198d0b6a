from datetime import date, datetime

import pytest

from strata.plans.incremental import (
    assign_slices, check_plan, covered_through, finished_slices, ledger_status, next_slices, plan_windows, slice_plan, slice_status, update_ledger,
)
from strata.plans.quality import ALL_RULES, Check, flagged_rows, rule_counts, rules_for, status_frame
from strata.plans.registry import ERROR_SHELLS_PC
from tests.conftest import star_frame


def test_high_water_mark_counts_complete_windows_only(spark):
    rows = [("2022-01-01_2022-07-01_eez-1.json", True), ("2022-06-01_2022-09-01_eez-1.json", False), ("2022-01-01_2022-02-01_eez-2.json", False),
            ("notes.json", True), ("2022-01-01_2022-13-01_eez-1.json", True)]
    got = {r["region"]: r["covered"] for r in covered_through(spark.createDataFrame(rows, "filename string, complete boolean")).collect()}
    assert got == {"eez-1": date(2022, 7, 1), "eez-2": None}


def windows(spark, covered, today, **options):
    marks = spark.createDataFrame([("r", covered)], "region string, covered date")
    r = plan_windows(marks, today, **options).first()
    return r["start_date"], r["end_date"], r["catching_up"]


def test_next_windows(spark):
    d = date
    assert windows(spark, d(2022, 7, 1), d(2022, 12, 1)) == (d(2022, 6, 24), d(2022, 9, 22), True)
    assert windows(spark, d(2022, 9, 22), d(2022, 12, 1)) == (d(2022, 9, 15), d(2022, 12, 1), False)
    assert windows(spark, d(2022, 12, 1), d(2022, 12, 1)) == (None, None, None)
    assert windows(spark, None, d(2022, 12, 1), since=d(2022, 11, 1)) == (d(2022, 11, 1), d(2022, 12, 1), False)
    for bad in (dict(covered=None, today=d(2022, 12, 1)), dict(covered=None, today=d(2022, 1, 1), since=d(2022, 1, 1)),
                dict(covered=d(2022, 1, 1), today=d(2022, 2, 1), max_days=0), dict(covered=d(2022, 1, 1), today=d(2022, 2, 1), overlap_days=-1)):
        with pytest.raises(ValueError):
            windows(spark, **bad)


def test_shells_are_contiguous_and_named(spark):
    rows = slice_plan(spark, "gaia/nearby-stars", 20, 26, 2).orderBy("ord").collect()
    assert [r["slice_id"] for r in rows] == [f"gaia/nearby-stars/{a}-{a + 2}pc" for a in (20, 22, 24)]
    assert [r["hi"] for r in rows] == [50.0, 45.4545, 41.6667] and rows[-1]["lo"] == 38.4615
    assert all(a["lo"] == b["hi"] for a, b in zip(rows, rows[1:]))
    assert slice_plan(spark, "x", 20, 25, 2).count() == 3 and slice_plan(spark, "x", stops=ERROR_SHELLS_PC).count() == 8
    for bad in ((0, 5, 1), (5, 5, 1), (1, 5, 0)):
        with pytest.raises(ValueError):
            slice_plan(spark, "x", *bad)


def test_slice_edges_and_completeness(spark):
    plan = slice_plan(spark, "x", 20, 26, 2)
    values = [50.0, 45.4545, 45.4546, 41.6667, 38.4615, 38.4616, 50.1]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = {r["p"]: r["slice_id"] for r in assign_slices(df, "p", plan).collect()}
    assert got == {50.0: "x/20-22pc", 45.4546: "x/20-22pc", 45.4545: "x/22-24pc", 41.6667: "x/24-26pc", 38.4616: "x/24-26pc"}
    status = {r["slice_id"]: (r["rows"], r["complete"]) for r in slice_status(df, "p", plan, 2).collect()}
    assert status == {"x/20-22pc": (2, False), "x/22-24pc": (1, True), "x/24-26pc": (2, False)}


def test_ledger_stops_at_the_first_incomplete_slice(spark):
    plan = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "ord int, slice_id string")
    ledger = spark.createDataFrame([("a", datetime(2026, 1, 1), "old")], "slice_id string, done_at_utc timestamp, note string")
    outcomes = spark.createDataFrame([(1, "b", 5, True), (2, "c", 9, False), (3, "d", 1, True)], "ord int, slice_id string, rows bigint, complete boolean")
    assert [r["slice_id"] for r in finished_slices(outcomes).collect()] == ["b"]
    after = update_ledger(ledger, plan, outcomes, datetime(2026, 2, 1))
    assert [(r["slice_id"], r["status"], r["note"]) for r in ledger_status(plan, after).collect()] == [
        ("a", "done", "old"), ("b", "done", "5 rows"), ("c", "pending", None), ("d", "pending", None)]
    assert [r["slice_id"] for r in next_slices(plan, after).collect()] == ["c"]
    with pytest.raises(ValueError, match="twice"):
        check_plan(plan.unionByName(plan.limit(1)))
    with pytest.raises(ValueError):
        next_slices(plan, ledger, 0)


def test_every_rule_flags_its_bad_row_only(spark):
    gaps = spark.sql("""SELECT * FROM VALUES ('ok', timestamp'2022-01-01', timestamp'2022-01-02', 24.0D), ('back', timestamp'2022-01-02', timestamp'2022-01-01', 1.0D),
        ('zero', timestamp'2022-01-01', timestamp'2022-01-02', 0.0D), ('none', timestamp'2022-01-01', NULL, NULL), ('long', timestamp'2022-01-01', timestamp'2026-01-01', 32651.93D)
        t(vessel_id, start, `end`, duration_hours)""")
    stars = star_frame(spark, dict(source_id=1, ra=1.0, dec=1.0, parallax=5.0, parallax_error=0.1, bp_rp=1.0), dict(source_id=2, ra=360.0, dec=1.0, parallax=5.0, bp_rp=1.0),
                       dict(source_id=3, ra=1.0, dec=1.0, parallax=0.0, bp_rp=1.0), dict(source_id=4, ra=1.0, dec=1.0, parallax=5.0, parallax_error=1.0, bp_rp=1.0),
                       dict(source_id=5, ra=1.0, dec=1.0, parallax=5.0, parallax_error=0.0))
    counts = {r["rule"]: (r["total"], r["flagged"], r["skipped"]) for r in rule_counts({"ocean.gap_events": gaps, "astro.nearby_stars": stars}, ALL_RULES).collect()}
    for name in ("end_before_start", "non_positive_duration", "missing_duration", "extreme_duration", "impossible_position", "no_valid_parallax", "weak_parallax", "no_colour"):
        assert counts[name] == (5, 1, False), name
    assert counts["no_host_star"] == (None, None, True)


def test_flagged_rows_and_statuses_leave_the_table_alone(spark, warehouse):
    crates = spark.createDataFrame([(i, i * 10 - 25, i) for i in range(8)], "crate int, weight int, _row_pos bigint")
    warehouse.upsert("harbour.crates", crates, "crate", source_file="scale.parquet")
    before = warehouse.state("harbour.crates")
    rules = [Check("light", "harbour.crates", "weight < 0", "error", "?"), Check("heavy", "harbour.crates", "weight >= 40", "warning", "?"),
             Check("absurd", "harbour.crates", "weight > 999", "error", "?"), Check("unseen", "harbour.cranes", "true", "warning", "?")]
    shown = [(r["rule"], r["row"]) for r in flagged_rows(warehouse, rules, per_rule=2).collect()]
    assert shown == [("light", '{"crate":0,"weight":-25}'), ("light", '{"crate":1,"weight":-15}'), ("heavy", '{"crate":7,"weight":45}')]
    counts = rule_counts({"harbour.crates": warehouse.table("harbour.crates")}, rules)
    assert {r["rule"]: (r["status"], r["text"]) for r in status_frame(counts).collect()} == {
        "light": ("ERROR", "3 of 8 rows"), "heavy": ("WARN", "1 of 8 rows"), "absurd": ("ok", "0 of 8 rows"), "unseen": ("skip", "harbour.cranes not found")}
    assert warehouse.state("harbour.crates") == before


def test_rule_definitions_are_checked():
    with pytest.raises(ValueError):
        Check("x", "a.b", "true", "fatal", "")
    with pytest.raises(ValueError):
        Check("x", "b", "true", "error", "")
    assert {r.table.split(".")[0] for r in rules_for("astro")} == {"astro"} and len(rules_for("astro")) == 10 and len(ALL_RULES) == 14
