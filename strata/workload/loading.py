"""Incremental, streamed and sliced loading."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from strata.operators.joins import pending
from strata.plans.incremental import (
    assign_slices, covered_through, finished_slices, ledger_status, next_slices, overall, plan_windows, refresh, slice_plan, slice_status, update_ledger,
)
from strata.plans.commits import Files
from strata.plans.ingest import ingest_incremental, new_files
from strata.plans.manifest import known_files
from strata.plans.registry import HOST_POSITIONS, PLANETS
from strata.session import scratch_dir
from strata.streaming.ingest import ingest_stream
from strata.workload.base import day, lake_of, planets, positions, query, t, write_csv
from strata.workload.curated import FETCHES_SQL, ORDERS, fetches_lake, shown, warehouse

# -- high-water mark and next window ------------------------------------------------------------------------------

def _window_manifest(spark, sf):
    """Orders stand for fetches: named by a window that ends at the order date, incomplete every fifth time."""
    o = t(spark, sf, "orders")
    ending = F.to_date("o_orderdate")
    name = F.concat(day(F.date_sub(ending, 30)), F.lit("_"), day(ending), F.lit("_"), F.when(F.col("o_custkey") % 50 == 7, F.lit("quiet")).otherwise(F.col("o_orderpriority")), F.lit(".json"))
    complete = (F.col("o_orderkey") % 5 != 0) & (F.col("o_custkey") % 50 != 7)
    return o.select(name.alias("filename"), complete.alias("complete"))


_MARKS = """
    SELECT CASE WHEN o_custkey % 50 = 7 THEN 'quiet' ELSE o_orderpriority END AS region,
           max(CASE WHEN o_orderkey % 5 <> 0 AND o_custkey % 50 <> 7 THEN CAST(o_orderdate AS DATE) END) AS covered FROM orders GROUP BY 1"""


@query("covered_through", f"SELECT region, strftime(covered, '%Y-%m-%d') AS covered FROM ({_MARKS})")
def marks(spark, sf):
    return covered_through(_window_manifest(spark, sf)).select("region", F.col("covered").cast("string").alias("covered"))


def _windows_sql(today: str) -> str:
    return f"""
    WITH m AS ({_MARKS}), w AS (SELECT region, CASE WHEN covered < DATE '{today}' THEN covered - 7 END AS s FROM m WHERE covered IS NOT NULL)
    SELECT region, strftime(s, '%Y-%m-%d') AS start_date, strftime(least(DATE '{today}', s + 90), '%Y-%m-%d') AS end_date,
           least(DATE '{today}', s + 90) < DATE '{today}' AS catching_up FROM w"""


def _windows(spark, sf, today):
    known = covered_through(_window_manifest(spark, sf)).filter("covered IS NOT NULL")
    plan = plan_windows(known, today)
    return plan.select("region", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "catching_up")


@query("next_windows", _windows_sql("2001-09-15").replace("least(DATE '2001-09-15', s + 90)", "CASE WHEN s IS NULL THEN NULL ELSE least(DATE '2001-09-15', s + 90) END"))
def next_windows(spark, sf):
    return _windows(spark, sf, date(2001, 9, 15))


@query("next_windows_far_behind", _windows_sql("2003-01-01").replace("least(DATE '2003-01-01', s + 90)", "CASE WHEN s IS NULL THEN NULL ELSE least(DATE '2003-01-01', s + 90) END"))
def next_windows_far_behind(spark, sf):
    return _windows(spark, sf, date(2003, 1, 1))


@query("next_windows_first_run", """
    SELECT DISTINCT CASE WHEN o_custkey % 50 = 7 THEN 'quiet' ELSE o_orderpriority END AS region, '2003-01-01' AS start_date, '2003-04-01' AS end_date, true AS catching_up FROM orders""")
def next_windows_first_run(spark, sf):
    plan = plan_windows(covered_through(_window_manifest(spark, sf)), date(2004, 1, 1), since=date(2003, 1, 1))
    return plan.select("region", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "catching_up")


@query("next_windows_refused", f"SELECT count(*) AS regions, count(*) FILTER (WHERE covered IS NULL) AS blank, count(*) FILTER (WHERE covered IS NULL) > 0 AS refused FROM ({_MARKS})")
def next_windows_refused(spark, sf):
    """A region without any complete fetch has nothing to continue from: without a first date the plan is refused."""
    known = covered_through(_window_manifest(spark, sf))
    try:
        plan_windows(known, date(2001, 9, 15))
        refused = False
    except ValueError:
        refused = True
    return known.agg(F.count("*").alias("regions"), F.count_if(F.col("covered").isNull()).alias("blank"), F.lit(refused).alias("refused"))


# -- loads --------------------------------------------------------------------------------------------------------

@query("ingest_incremental", FETCHES_SQL)
def incremental(spark, sf):
    """All three fetches at once, then again: the second run finds nothing new."""
    lake, wh = fetches_lake(spark, sf), warehouse(spark)
    ingest_incremental(spark, lake, wh, ORDERS)
    assert ingest_incremental(spark, lake, wh, ORDERS).files == 0
    return shown(wh.table("shop.orders"))


def _landing_lake(spark, sf, root, days) -> None:
    """Orders of a year land on a day each; what landed on the last day is known to be incomplete."""
    o = t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    files = Files(spark)
    for year in days:
        folder = f"{root}/raw/shop/orders/{year}-12-31"
        write_csv(o.filter(F.col("year") == year).select(
            "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")), folder)
        for name, _ in files.names(folder):
            if name.endswith(".csv") and year == 1997:
                files.create(f"{folder}/{name}.meta.json", json.dumps({"complete": False, "fetched_at_utc": f"{year}-12-31T10:00:00Z"}))


@query("stored_manifest", """
    SELECT concat(year(o_orderdate), '-12-31') AS fetch_date, true AS files, year(o_orderdate) <> 1997 AS complete, count(*) AS rows_in_table, false AS new_at_the_end
    FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997 GROUP BY year(o_orderdate)""")
def stored_manifest(spark, sf):
    """Two ingests with a landing between them: the manifest holds every file once, and the rows of incomplete fetches are loaded as well."""
    wh, lake = warehouse(spark), scratch_dir(spark, "landing")
    _landing_lake(spark, sf, lake, (1995, 1996))
    first = ingest_incremental(spark, lake, wh, ORDERS)
    _landing_lake(spark, sf, lake, (1997,))
    second = ingest_incremental(spark, lake, wh, ORDERS)
    assert first.complete and not second.complete
    held = known_files(wh, ORDERS).groupBy("fetch_date").agg((F.count("*") > 0).alias("files"), F.min("complete").alias("complete"))
    rows = wh.table("shop.orders").groupBy(F.concat(F.year("o_orderdate"), F.lit("-12-31")).alias("fetch_date")).agg(F.count("*").alias("rows_in_table"))
    left = new_files(spark, lake, wh, ORDERS).select("fetch_date").distinct().withColumn("new_at_the_end", F.lit(True))
    return (held.join(rows, "fetch_date", "full_outer").join(left, "fetch_date", "full_outer")
            .select("fetch_date", "files", "complete", "rows_in_table", F.coalesce("new_at_the_end", F.lit(False)).alias("new_at_the_end")))


@query("ingest_stream", FETCHES_SQL)
def stream(spark, sf):
    """The same files found by a stream, a few per batch, in whatever order the folders are listed."""
    lake, wh = fetches_lake(spark, sf), warehouse(spark)
    ingest_stream(spark, lake, wh, ORDERS, scratch_dir(spark, "stream"), max_files=12).awaitTermination()
    return shown(wh.table("shop.orders"))


@query("refresh_steps", """
    SELECT 'planets' AS step, count(*) > 0 AS ok, CAST(0 AS INTEGER) AS severity FROM supplier
    UNION ALL SELECT 'host-positions', count(*) > 0, CAST(0 AS INTEGER) FROM supplier
    UNION ALL SELECT 'quality', count(*) FILTER (WHERE s_suppkey % 50 = 0 OR s_suppkey % 40 = 0 OR (s_acctbal <= 0 AND s_suppkey % 9 <> 0)) = 0,
      CAST(CASE WHEN count(*) FILTER (WHERE s_suppkey % 50 = 0 OR s_suppkey % 40 = 0 OR (s_acctbal <= 0 AND s_suppkey % 9 <> 0)) > 0 THEN 1 ELSE 0 END AS INTEGER) FROM supplier""")
def refresh_steps(spark, sf):
    return refresh(spark, _planet_lake(spark, sf), warehouse(spark)).select("step", "ok", "severity")


@query("refresh_overall", """
    SELECT CAST(CASE WHEN count(*) FILTER (WHERE s_suppkey % 50 = 0 OR s_suppkey % 40 = 0 OR (s_acctbal <= 0 AND s_suppkey % 9 <> 0)) > 0 THEN 1 ELSE 0 END AS INTEGER) AS severity FROM supplier""")
def refresh_overall(spark, sf):
    return overall(refresh(spark, _planet_lake(spark, sf), warehouse(spark)))


def _planet_lake(spark, sf):
    def build(root):
        k = F.col("sy_pnum")
        full = planets(spark, sf).withColumns({c: F.lit(1.5) for c in ("sy_dist", "sy_plx", "sy_gaiamag")}).withColumns(
            {"sy_pnum": F.lit(1), "disc_year": F.lit(2016), "discoverymethod": F.lit("Transit")})
        write_csv(full.filter(k.isNotNull()), f"{root}/raw/{PLANETS.source}/{PLANETS.name}/2024-06-01")
        write_csv(positions(spark, sf).withColumn("hostname", F.lit("h")), f"{root}/raw/{HOST_POSITIONS.source}/{HOST_POSITIONS.name}/2024-06-01")

    return lake_of(spark, sf, "planet-lake", build)


# -- slices -------------------------------------------------------------------------------------------------------

_STOPS = (2.0, 2.2, 2.5, 3.0, 4.0, 5.0, 10.0, 50.0)
_PLAN = """
    WITH e AS (SELECT * FROM (VALUES (0, 2.0, 2.2, '2-2.2'), (1, 2.2, 2.5, '2.2-2.5'), (2, 2.5, 3.0, '2.5-3'), (3, 3.0, 4.0, '3-4'), (4, 4.0, 5.0, '4-5'),
                                     (5, 5.0, 10.0, '5-10'), (6, 10.0, 50.0, '10-50')) v(ord, a, b, label)),
    plan AS (SELECT CAST(ord AS INTEGER) AS ord, 'shop/orders/' || label || 'pc' AS slice_id, round(1000.0 / b, 4) AS lo, round(1000.0 / a, 4) AS hi FROM e),
    x AS (SELECT o_orderkey, o_totalprice / 1000 AS p FROM orders),
    status AS (SELECT ord, slice_id, count(p) AS rows, count(p) < (SELECT count(*) FROM x) / 8.0 AS complete FROM plan LEFT JOIN x ON p > lo AND p <= hi GROUP BY 1, 2)"""


def _plan(spark):
    return slice_plan(spark, "shop/orders", stops=_STOPS)


def _status(spark, sf):
    x = t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("p"))
    return x, slice_status(x, "p", _plan(spark), max(1, -(-x.count() // 8)))


@query("slice_rows", _PLAN + " SELECT slice_id, round(lo, 4) AS lo, round(hi, 4) AS hi, count(p) AS n FROM plan LEFT JOIN x ON p > lo AND p <= hi GROUP BY ALL")
def slice_rows(spark, sf):
    x, _ = _status(spark, sf)
    counts = assign_slices(x, "p", _plan(spark)).groupBy("slice_id").agg(F.count("*").alias("n"))
    return _plan(spark).join(counts, "slice_id", "left").select("slice_id", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


@query("slice_status", _PLAN + " SELECT * FROM status")
def status_of_slices(spark, sf):
    return _status(spark, sf)[1]


_LEDGER = _PLAN + """,
    stop AS (SELECT min(ord) AS cut FROM status WHERE NOT complete),
    done AS (SELECT ord, slice_id, CAST(rows AS VARCHAR) || ' rows' AS note FROM status, stop WHERE complete AND (cut IS NULL OR ord < cut))"""


def _ledger(spark, sf):
    _, status = _status(spark, sf)
    empty = spark.createDataFrame([], "slice_id string, done_at_utc timestamp, note string")
    return update_ledger(empty, _plan(spark), status, datetime(2024, 7, 1))


@query("slice_ledger", _LEDGER + " SELECT slice_id, '2024-07-01' AS done_on, note FROM done")
def slice_ledger(spark, sf):
    return _ledger(spark, sf).select("slice_id", day("done_at_utc").alias("done_on"), "note")


@query("slice_ledger_status", _LEDGER + " SELECT plan.ord, plan.slice_id, CASE WHEN done.ord IS NULL THEN 'pending' ELSE 'done' END AS status, note FROM plan LEFT JOIN done USING (slice_id)")
def slice_ledger_status(spark, sf):
    return ledger_status(_plan(spark), _ledger(spark, sf))


@query("pending_slices", _LEDGER + " SELECT ord, slice_id FROM plan WHERE slice_id NOT IN (SELECT slice_id FROM done)")
def pending_slices(spark, sf):
    return pending(_plan(spark), _ledger(spark, sf)).select("ord", "slice_id")


@query("next_slices", _LEDGER + " SELECT ord, slice_id FROM plan WHERE slice_id NOT IN (SELECT slice_id FROM done) ORDER BY ord LIMIT 2")
def slices_to_run(spark, sf):
    return next_slices(_plan(spark), _ledger(spark, sf), 2).select("ord", "slice_id")


@query("finished_slices", _LEDGER + " SELECT slice_id FROM done")
def slices_that_count(spark, sf):
    return finished_slices(_status(spark, sf)[1]).select("slice_id")
