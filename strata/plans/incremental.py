"""Incremental and sliced loading: high-water marks, next windows, slice plans and their ledger."""

from __future__ import annotations

from datetime import date

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.names import require
from strata.functions.scalars import next_window, parse_window_name, shell_edges, shells_between
from strata.operators.aggregates import worst_severity
from strata.operators.joins import pending
from strata.plans.ingest import ingest_files, new_files
from strata.plans.quality import rule_counts, rules_for
from strata.plans.registry import HOST_POSITIONS, PLANETS
from strata.plans.warehouse import Warehouse


def covered_through(manifest: DataFrame, by: str = "region") -> DataFrame:
    """(region, covered): the latest window end among complete fetches, NULL where there is none.

    `manifest` needs filename and complete; window and region are read from the file name.
    """
    _, end, region = parse_window_name("filename")
    windows = manifest.select(region.alias(by), end.alias("_end"), "complete").filter(F.col(by).isNotNull())
    return windows.groupBy(by).agg(F.max(F.when(F.col("complete"), F.col("_end"))).alias("covered"))


def plan_windows(marks: DataFrame, today: date, overlap_days: int = 7, max_days: int = 90,
                 since: date | None = None, by: str = "region") -> DataFrame:
    """(region, start_date, end_date, catching_up) for every region; NULL once covered through today.

    Without `since`, a region that has no complete fetch yet is an error: there is nothing to continue from.
    """
    start, end, catching_up = next_window("covered", today, overlap_days, max_days, since)
    if since is None:
        blank = marks.filter(F.col("covered").isNull()).limit(1).collect()
        require(not blank, f"no earlier complete fetch for {blank[0][by] if blank else ''}; give a first start date with since")
    return marks.select(by, start.alias("start_date"), end.alias("end_date"), catching_up.alias("catching_up"))


def slice_plan(spark: SparkSession, prefix: str, near: float | None = None, far: float | None = None,
               step: float | None = None, stops=None) -> DataFrame:
    """(ord, slice_id, lo, hi): contiguous parallax shells, nearest first, from a range or from explicit distances."""
    shells = shells_between(spark, list(stops)) if stops is not None else shell_edges(spark, near, far, step)

    def short(c: str):
        return F.regexp_replace(F.col(c).cast("decimal(20,6)").cast("string"), r"\.?0+$", "")

    label = F.concat(F.lit(prefix + "/"), short("near_pc"), F.lit("-"), short("far_pc"), F.lit("pc"))
    return shells.select("ord", label.alias("slice_id"), "lo", "hi")


def check_plan(plan: DataFrame) -> None:
    """Slice ids must be unique."""
    twice = plan.groupBy("slice_id").count().filter("count > 1").limit(1).collect()
    require(not twice, f"slice id appears twice in the plan: {twice[0]['slice_id'] if twice else ''}")


def assign_slices(df: DataFrame, column: str, plan: DataFrame) -> DataFrame:
    """Rows with the slice they fall into (lo < x <= hi); rows outside the plan are dropped.

    The plan's edges reach the driver, and each row finds its shell by binary search instead of a range join.
    """
    rows = [tuple(r) for r in plan.select("hi", "lo", "slice_id", "ord").orderBy(F.col("hi").desc()).collect()]
    require(all(a[1] == b[0] for a, b in zip(rows, rows[1:])), "slices must be contiguous")
    # Negated, (lo, hi] becomes [-hi, -lo), the kind of range a Bucketizer knows; its last range also takes -lo.
    splits = [-rows[0][0], *[-r[1] for r in rows]]
    last = rows[-1][1]
    inside = df.filter((F.col(column) > last) & (F.col(column) <= rows[0][0])).withColumn("_minus", -F.col(column).cast("double"))
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="_minus", outputCol="_slot", handleInvalid="skip").transform(inside)
    else:
        cut = inside.withColumn("_slot", F.lit(0.0))
    ids = F.array(*[F.lit(r[2]) for r in rows])
    return cut.withColumn("slice_id", F.element_at(ids, F.col("_slot").cast("int") + 1)).drop("_minus", "_slot")


def slice_status(df: DataFrame, column: str, plan: DataFrame, limit: int) -> DataFrame:
    """(ord, slice_id, rows, complete): a slice with `limit` rows or more may have been cut off."""
    require(limit >= 1, "limit must be 1 or more")
    counts = assign_slices(df, column, plan).groupBy("slice_id").agg(F.count("*").alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    return plan.join(counts, "slice_id", "left").select("ord", "slice_id", rows.alias("rows"), (rows < limit).alias("complete"))


def finished_slices(outcomes: DataFrame) -> DataFrame:
    """Outcomes that count: complete ones before the first incomplete slice, because that one stops the run."""
    stop = outcomes.filter(~F.col("complete")).agg(F.min("ord").alias("stop"))
    first = stop.first()["stop"]
    done = outcomes.filter("complete")
    return done if first is None else done.filter(F.col("ord") < first)


def update_ledger(ledger: DataFrame, plan: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Ledger (slice_id, done_at_utc, note) with the newly finished slices added."""
    check_plan(plan)
    done = finished_slices(outcomes).join(ledger.select("slice_id"), "slice_id", "left_anti")
    note = F.col("note") if "note" in outcomes.columns else F.concat(F.col("rows").cast("string"), F.lit(" rows"))
    fresh = done.select("slice_id", F.lit(now).cast("timestamp").alias("done_at_utc"), note.alias("note"))
    return ledger.select("slice_id", "done_at_utc", "note").unionByName(fresh)


def ledger_status(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """(ord, slice_id, status, note) in plan order."""
    known = ledger.select("slice_id", "note", F.lit(True).alias("_done"))
    status = F.when(F.col("_done"), "done").otherwise("pending")
    return plan.join(known, "slice_id", "left").select("ord", "slice_id", status.alias("status"), "note").orderBy("ord")


def next_slices(plan: DataFrame, ledger: DataFrame, max_slices: int = 1) -> DataFrame:
    """The slices to run now, in plan order; one per run is the throttle."""
    require(max_slices >= 1, "max_slices must be 1 or more")
    check_plan(plan)
    return pending(plan, ledger).limit(max_slices)


def refresh(spark: SparkSession, lake: str, warehouse: Warehouse, datasets=(PLANETS, HOST_POSITIONS), schema: str = "astro") -> DataFrame:
    """(step, ok, severity, note): take in new snapshots, then run the domain's rules.

    Every step runs even if an earlier one failed. severity: 0 fine, 1 an error rule flagged rows, 2 a load failed or
    is not known to be complete. Nothing new to load is fine.
    """
    steps = []
    for dataset in datasets:
        try:
            r = ingest_files(spark, lake, warehouse, dataset, new_files(spark, lake, warehouse, dataset))
        except Exception as error:  # noqa: BLE001 - reported as a failed step
            steps.append((dataset.name, False, 2, f"failed: {type(error).__name__}: {error}"))
            continue
        if not r.files:
            steps.append((dataset.name, True, 0, "already taken in: skipped"))
        else:
            steps.append((dataset.name, r.complete, 0 if r.complete else 2, f"{r.upsert.new} new, {r.upsert.updated} updated, {r.upsert.total} total"))
    rules = rules_for(schema)
    tables = {t: warehouse.table(t) for t in warehouse.tables() if t in {r.table for r in rules}}
    if not tables:
        steps.append(("quality", False, 2, "failed: no tables"))
    else:
        worst = worst_severity(rule_counts(tables, rules)).first()
        bad = worst["errors"] > 0
        steps.append(("quality", not bad, 1 if bad else 0, f"{worst['errors']} errors, {worst['warnings']} warnings"))
    return spark.createDataFrame(steps, "step string, ok boolean, severity int, note string")


def overall(steps: DataFrame) -> DataFrame:
    """The code of a whole run: a failed load outweighs a flagged row."""
    return steps.agg(F.max("severity").alias("severity"))
