"""Curated tables: loads, upserts, publication, rebuild. Every query works on a warehouse of its own in shared scratch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.plans.ingest import compare_warehouses, ingest_incremental, rebuild
from strata.plans.registry import Dataset
from strata.plans.warehouse import UpsertReport, Warehouse
from strata.session import scratch_dir
from strata.workload.base import lake_of, query, t, write_csv


def warehouse(spark: SparkSession) -> Warehouse:
    return Warehouse(spark, scratch_dir(spark, "warehouse"), catalog=False)


@query("load_replaces", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS balance FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1")
def load_replaces(spark, sf):
    wh, rows = warehouse(spark), t(spark, sf, "customer")
    wh.load_table(rows.filter("c_custkey % 2 = 0"), "shop", "customer")
    wh.load_table(rows.filter("c_custkey % 2 = 1"), "shop", "customer")
    return wh.table("shop.customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("balance"))


def _first(spark, sf) -> DataFrame:
    return t(spark, sf, "orders").filter("o_orderkey % 3 <> 0").select(
        "o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("_row_pos"))


def _second(spark, sf) -> DataFrame:
    """Overlaps the first batch, holds every seventh key twice and every eleventh row without a key."""
    o = t(spark, sf, "orders").filter("o_orderkey % 2 = 0")
    key = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey"))
    one = o.select(key.alias("o_orderkey"), "o_orderpriority", (F.col("o_totalprice") + 1).alias("price"), F.col("o_orderkey").alias("_row_pos"))
    two = o.filter("o_orderkey % 7 = 0").select(key.alias("o_orderkey"), "o_orderpriority", (F.col("o_totalprice") + 2).alias("price"),
                                               (F.col("o_orderkey") + 1_000_000_000_000).alias("_row_pos"))
    return one.unionByName(two)


def _two_batches(spark, sf) -> tuple[Warehouse, UpsertReport]:
    wh = warehouse(spark)
    wh.upsert("shop.orders", _first(spark, sf), "o_orderkey", source_file="first.parquet", parts=16)
    report = wh.upsert("shop.orders", _second(spark, sf), "o_orderkey", source_file="second.parquet")
    return wh, report


_BATCHES = """
    WITH a AS (SELECT o_orderkey, o_orderpriority, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
    b AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS o_orderkey, o_orderpriority, o_totalprice + 1 AS price, 0 AS pos FROM orders WHERE o_orderkey % 2 = 0
          UNION ALL SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END, o_orderpriority, o_totalprice + 2, 1 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 = 0),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos DESC) AS rn FROM b WHERE o_orderkey IS NOT NULL) WHERE rn = 1)"""


@query("upsert_latest_wins", _BATCHES + """
    SELECT o_orderkey, o_orderpriority, price, 'first.parquet' AS _source_file FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d)
    UNION ALL SELECT o_orderkey, o_orderpriority, price, 'second.parquet' FROM d""")
def upsert_latest_wins(spark, sf):
    wh, _ = _two_batches(spark, sf)
    return wh.table("shop.orders")


@query("upsert_report", _BATCHES + """
    SELECT (SELECT count(*) FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) AS "new",
           (SELECT count(*) FROM d WHERE o_orderkey IN (SELECT o_orderkey FROM a)) AS updated,
           (SELECT count(*) FROM b WHERE o_orderkey IS NULL) AS skipped_no_key,
           (SELECT count(o_orderkey) FROM b) - (SELECT count(*) FROM d) AS duplicates_in_file,
           (SELECT count(*) FROM (SELECT o_orderkey FROM a UNION SELECT o_orderkey FROM d)) AS total, CAST(0 AS BIGINT) AS stale""")
def upsert_report(spark, sf):
    wh, report = _two_batches(spark, sf)
    return report.as_frame(spark)


@query("lineage_of_plain_table", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size + 100 ELSE p_size END AS p_size,
           CASE WHEN p_partkey % 2 = 0 THEN 'fix.parquet' END AS _source_file FROM part""")
def lineage_of_plain_table(spark, sf):
    """A table loaded without lineage gains the column at its first upsert; old rows stay unknown."""
    wh, rows = warehouse(spark), t(spark, sf, "part").select("p_partkey", "p_size")
    wh.load_table(rows, "shop", "part")
    fixed = rows.filter("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 100)
    wh.upsert("shop.part", fixed, "p_partkey", order=["p_size"], source_file="fix.parquet")
    return wh.table("shop.part")


@query("schema_drift_guard", "SELECT count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys, true AS refused FROM supplier")
def schema_drift_guard(spark, sf):
    """A batch with another column is refused and the table stays as it was."""
    wh, rows = warehouse(spark), t(spark, sf, "supplier").select("s_suppkey", "s_name")
    wh.upsert("shop.supplier", rows, "s_suppkey", order=["s_name"])
    refused = False
    try:
        wh.upsert("shop.supplier", rows.withColumn("surprise", F.lit(1)), "s_suppkey", order=["s_name"])
    except ValueError:
        refused = True
    return wh.table("shop.supplier").agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"), F.lit(refused).alias("refused"))


@query("failed_load_changes_nothing", "SELECT o_orderstatus, count(*) AS n, true AS failed FROM orders GROUP BY 1")
def failed_load_changes_nothing(spark, sf):
    """A load that breaks half-way is never published."""
    wh, rows = warehouse(spark), t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    wh.load_table(rows, "shop", "orders")
    broken = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 7, F.raise_error(F.lit("bad row")).cast("double")).otherwise(F.col("o_totalprice")))
    failed = False
    try:
        wh.load_table(broken, "shop", "orders")
    except Exception:  # noqa: BLE001 - the failure is the point
        failed = True
    return wh.table("shop.orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.lit(failed).alias("failed"))


ORDERS = Dataset("shop", "orders", "csv", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "price": "float", "o_orderdate": "timestamp"},
                 ("o_orderkey",), "shop.orders")


def fetches_lake(spark: SparkSession, sf: str) -> str:
    """Three overlapping fetches of orders on three days; revised prices tell them apart. One folder is of no known dataset."""
    def build(root: str) -> None:
        o = t(spark, sf, "orders")

        def fetch(every: int, rest: int, plus: int) -> DataFrame:
            return o.filter(F.col("o_orderkey") % every != rest).select(
                "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") + plus).alias("price"),
                F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.lit("x").alias("dropped"))

        for when, every, rest, plus in (("2024-05-03", 4, 1, 2), ("2024-05-01", 3, 0, 0), ("2024-05-02", 5, 2, 1)):
            write_csv(fetch(every, rest, plus), f"{root}/raw/shop/orders/{when}")
        write_csv(t(spark, sf, "region"), f"{root}/raw/shop/regions/2024-05-01")

    return lake_of(spark, sf, "fetches-lake", build)


FETCHES_SQL = """
    SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 1 THEN o_totalprice + 2 WHEN o_orderkey % 5 <> 2 THEN o_totalprice + 1 ELSE o_totalprice END AS price,
           strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
           CASE WHEN o_orderkey % 4 <> 1 THEN '2024-05-03' WHEN o_orderkey % 5 <> 2 THEN '2024-05-02' ELSE '2024-05-01' END AS fetched
    FROM orders WHERE o_orderkey % 4 <> 1 OR o_orderkey % 5 <> 2 OR o_orderkey % 3 <> 0"""


def shown(table: DataFrame) -> DataFrame:
    return table.select("o_orderkey", "o_custkey", "o_orderstatus", "price", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
                        F.date_format("_fetched_at", "yyyy-MM-dd").alias("fetched"))


@query("rebuild_equivalence", FETCHES_SQL)
def rebuild_equivalence(spark, sf):
    wh = warehouse(spark)
    rebuild(spark, fetches_lake(spark, sf), wh, datasets={("shop", "orders"): ORDERS})
    return shown(wh.table("shop.orders"))


@query("rebuild_comparison", f"SELECT 'shop.orders' AS \"table\", count(*) AS rows_a, count(*) AS rows_b, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, true AS same FROM ({FETCHES_SQL})")
def rebuild_comparison(spark, sf):
    """The lake taken in incrementally against the lake rebuilt from raw."""
    lake, live, fresh = fetches_lake(spark, sf), warehouse(spark), warehouse(spark)
    ingest_incremental(spark, lake, live, ORDERS)
    rebuild(spark, lake, fresh, datasets={("shop", "orders"): ORDERS})
    return compare_warehouses(live, fresh)


@query("rebuild_report", f"SELECT 'shop.orders' AS \"table\", count(*) AS n_rows, CAST(1 AS BIGINT) AS unknown FROM ({FETCHES_SQL})")
def rebuild_report(spark, sf):
    report = rebuild(spark, fetches_lake(spark, sf), warehouse(spark), datasets={("shop", "orders"): ORDERS})
    rows = [(name, n, len(report.skipped)) for name, n in report.tables.items()]
    return spark.createDataFrame(rows, "`table` string, n_rows bigint, unknown bigint")
