"""Registration of queries and the derived inputs they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.session import scratch_dir, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(use_utc(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


_LAKES: dict[tuple[str, str, str], str] = {}


def lake_of(spark: SparkSession, sf: str, label: str, build: Callable[[str], None]) -> str:
    """A raw zone that Spark writes once per session from the given tables."""
    at = (spark.sparkContext.applicationId, sf, label)
    if at not in _LAKES:
        root = scratch_dir(spark, label)
        build(root)
        _LAKES[at] = root
    return _LAKES[at]


def write_csv(df: DataFrame, folder: str) -> None:
    """Part files with a header each: every one is a raw file of its own."""
    (df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(folder))


# Statuses of orders stand for three fetches on three days.
FETCH_DAYS = {"F": "2024-01-01", "O": "2024-01-02", "P": "2024-01-03"}
FETCH_SQL = "CASE o_orderstatus WHEN 'F' THEN '2024-01-01' WHEN 'O' THEN '2024-01-02' ELSE '2024-01-03' END"


def orders_lake(spark: SparkSession, sf: str) -> str:
    """raw/shop/orders/<day>/*.csv without sidecars."""
    def build(root: str) -> None:
        orders = t(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        for status, when in FETCH_DAYS.items():
            write_csv(orders.filter(F.col("o_orderstatus") == status), f"{root}/raw/shop/orders/{when}")

    return lake_of(spark, sf, "orders-lake", build)


# -- stars made of rows -------------------------------------------------------------------------------------------
# Positions repeat every 360 keys up to a few arcseconds, so neighbours and ambiguous matches occur at every size.

_STAR_COLUMNS = {
    "source_id": "{k}",
    "ra": "CAST(({k} * 37) % 360 AS DOUBLE) + CAST({k} % 7 AS DOUBLE) * CAST(0.0005 AS DOUBLE)",
    "dec": "CAST(({k} * 17) % 170 - 85 AS DOUBLE) + CAST({k} % 5 AS DOUBLE) * CAST(0.0004 AS DOUBLE)",
    "parallax": "CASE WHEN {k} % 31 = 0 THEN NULL WHEN {k} % 29 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(20 + ({k} * 13) % 90 AS DOUBLE) END",
    "parallax_error": "CAST(5 + {k} % 10 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "pmra": "CASE WHEN {k} % 23 = 0 THEN NULL ELSE CAST(({k} % 401 - 200) * 10 AS DOUBLE) END",
    "pmdec": "CASE WHEN {k} % 23 = 0 THEN NULL ELSE CAST(({k} % 307 - 150) * 8 AS DOUBLE) END",
    "phot_g_mean_mag": "CASE WHEN {k} % 37 = 0 THEN NULL ELSE CAST(500 + ({k} * 31) % 1500 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "bp_rp": "CASE WHEN {k} % 19 = 0 THEN NULL ELSE CAST(({k} * 53) % 400 AS DOUBLE) / CAST(100 AS DOUBLE) END",
    "radial_velocity": "CASE WHEN {k} % 3 = 0 THEN NULL ELSE CAST({k} % 211 - 105 AS DOUBLE) END",
}


def stars(spark: SparkSession, sf: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    return t(spark, sf, table).selectExpr(*[f"{e.format(k=key)} AS `{n}`" for n, e in _STAR_COLUMNS.items()])


def stars_sql(table: str = "customer", key: str = "c_custkey") -> str:
    columns = ", ".join(f'{e.format(k=key)} AS "{n}"' for n, e in _STAR_COLUMNS.items())
    return f"SELECT {columns} FROM {table}"


# Suppliers stand for planets: a third has a readable id, some an unreadable one, the rest a position only.
_PLANET_COLUMNS = {
    "pl_name": "s_name",
    "hostname": "CASE WHEN s_suppkey % 50 = 0 THEN NULL ELSE concat('Host ', CAST(s_nationkey AS {text})) END",
    "gaia_dr3_id": "CASE WHEN s_suppkey % 3 = 0 THEN concat('Gaia DR3 ', CAST(s_suppkey * 7 AS {text})) WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE NULL END",
    "pl_orbper": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal END",
    "pl_bmasse": "CAST(s_suppkey % 40 AS DOUBLE)",
    "pl_rade": "CAST(s_suppkey % 25 + 1 AS DOUBLE)",
}
_POSITION_COLUMNS = {
    "pl_name": "s_name",
    "ra": "CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST((s_suppkey * 407) % 360 AS DOUBLE) + CAST((s_suppkey * 11) % 7 AS DOUBLE) * CAST(0.0005 AS DOUBLE) + CAST(0.0003 AS DOUBLE) END",
    "dec": "CAST((s_suppkey * 187) % 170 - 85 AS DOUBLE) + CAST((s_suppkey * 11) % 5 AS DOUBLE) * CAST(0.0004 AS DOUBLE) - CAST(0.0002 AS DOUBLE)",
}


def planets(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "supplier").selectExpr(*[f"{e.format(text='STRING')} AS `{n}`" for n, e in _PLANET_COLUMNS.items()])


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "supplier").selectExpr(*[f"{e} AS `{n}`" for n, e in _POSITION_COLUMNS.items()])


def planets_sql() -> str:
    return "SELECT " + ", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in _PLANET_COLUMNS.items()) + " FROM supplier"


def positions_sql() -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _POSITION_COLUMNS.items()) + " FROM supplier"


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
