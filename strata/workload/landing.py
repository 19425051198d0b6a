"""Raw zone and cleaning: the given tables are written out as raw files first, then scanned, checked and cleaned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.functions.parsing import TYPES, blank_to_null, parse
from strata.functions.scalars import content_hash, parse_window_name
from strata.operators.cleaning import (
    bad_value_counts, band_select, clean, clean_json, clean_report, read_clean, write_clean, write_clean_reported,
)
from strata.plans.registry import DATASETS, registry_frame
from strata.plans.warehouse import query as read_only
from strata.session import scratch_dir
from strata.sources.csv import scan_csv, validate_payloads
from strata.sources.files import RAW_LAYOUT, with_path_parts
from strata.sources.json import scan_json
from strata.sources.parquet import parquet_glob, scan_clean
from strata.sources.raw import fetch_completeness, page_audit, provenance, raw_files, register_raw, verify_raw
from strata.workload.base import FETCH_SQL, day, lake_of, orders_lake, query, t, write_csv


def fetch_date(path: str = "path"):
    return F.regexp_extract(path, RAW_LAYOUT, 3)


# -- scans --------------------------------------------------------------------------------------------------------

@query("raw_listing", f"SELECT DISTINCT 'shop' AS source, 'orders' AS dataset, {FETCH_SQL} AS fetch_date, true AS has_files FROM orders")
def raw_listing(spark: SparkSession, sf: str) -> DataFrame:
    files = raw_files(spark, orders_lake(spark, sf)).filter("size_bytes > 0")
    return files.groupBy("source", "dataset", "fetch_date").agg((F.count("*") > 0).alias("has_files"))


@query("raw_provenance", f"""
    SELECT DISTINCT {FETCH_SQL} AS fetch_date, {FETCH_SQL} || ' 00:00:00' AS fetched_at, false AS has_sidecar, true AS complete FROM orders""")
def raw_provenance(spark, sf):
    rows = provenance(spark, orders_lake(spark, sf))
    return rows.select("fetch_date", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "has_sidecar", "complete").distinct()


@query("raw_integrity", f"""
    SELECT DISTINCT {FETCH_SQL} AS fetch_date,
           CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'changed' ELSE 'no_sidecar' END AS status FROM orders""")
def raw_integrity(spark, sf):
    lake = orders_lake(spark, sf)
    found = verify_raw(spark, lake)
    recorded = found.filter("fetch_date < '2024-01-03'").select(
        "path", F.col("size_bytes").alias("stated_size"),
        F.when(F.col("fetch_date") == "2024-01-02", F.reverse("sha256")).otherwise(F.col("sha256")).alias("stated_sha256"))
    return verify_raw(spark, lake, manifest=recorded).select("fetch_date", "status").distinct()


# Customers of a region are fetched on one day. What the sidecars of the five regions say, as JSON after the core fields:
_SIDECARS = (
    '"fetched_at_utc": "2024-05-01T10:00:00Z", "complete": true, "rows": 7',  # fetched long after the day of the folder
    '"fetched_at_utc": "2024-01-15T01:30:00+02:00", "complete": null',  # fetched before it, and not known to be complete
    None,  # no sidecar
    "damaged",
    '"complete": false',  # no fetch time: the day of the folder counts
)


def sidecar_lake(spark: SparkSession, sf: str) -> str:
    """raw/shop/customers/2024-03-0<region + 1>/* with sidecars that state size and checksum; region 1 states a wrong checksum, region 4 a wrong size."""
    def build(root: str) -> None:
        people = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        for region, said in enumerate(_SIDECARS):
            folder = f"{root}/raw/shop/customers/2024-03-0{region + 1}"
            people.filter(F.col("n_regionkey") == region).select(F.concat_ws(",", "c_custkey", "c_name").alias("value")).write.text(folder)
            if said is None:
                continue
            # One row per file, with the checksum of its text; the audit reads bytes.
            files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.octet_length("value").alias("n"), F.sha2("value", 256).alias("sha"))
            for f in files.collect():
                size, sha = f["n"] + (region == 4), f["sha"][::-1] if region == 1 else f["sha"]
                text = f'{{"size_bytes": {size}, "sha256": "{sha}", {said}}}' if said != "damaged" else '{"sha256": '
                target = spark._jvm.org.apache.hadoop.fs.Path(f["at"] + ".meta.json")
                out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
                out.write(bytearray(text.encode()))
                out.close()

    return lake_of(spark, sf, "sidecar-lake", build)


@query("sidecar_provenance", """
    SELECT DISTINCT concat('2024-03-0', n_regionkey + 1) AS fetch_date, n_regionkey <> 2 AS has_sidecar, n_regionkey IN (0, 2) AS complete,
      CASE n_regionkey WHEN 0 THEN '2024-05-01 10:00:00' WHEN 1 THEN '2024-01-14 23:30:00' ELSE concat('2024-03-0', n_regionkey + 1, ' 00:00:00') END AS fetched_at,
      CAST(CASE n_regionkey WHEN 0 THEN 7 END AS BIGINT) AS "rows"
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def sidecar_provenance(spark, sf):
    rows = provenance(spark, sidecar_lake(spark, sf)).filter("size_bytes > 0")
    return rows.select("fetch_date", "has_sidecar", "complete", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "rows").distinct()


@query("sidecar_integrity", """
    SELECT DISTINCT concat('2024-03-0', n_regionkey + 1) AS fetch_date, CASE n_regionkey WHEN 0 THEN 'ok' WHEN 1 THEN 'changed' WHEN 4 THEN 'changed' ELSE 'no_sidecar' END AS status
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def sidecar_integrity(spark, sf):
    return verify_raw(spark, sidecar_lake(spark, sf)).filter("size_bytes > 0").select("fetch_date", "status").distinct()


@query("csv_scan", f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority, {FETCH_SQL} AS fetch_date FROM orders")
def csv_scan(spark, sf):
    rows = scan_csv(spark, f"{orders_lake(spark, sf)}/raw/shop/orders/*/*.csv", ["o_orderpriority", "o_orderkey", "o_orderstatus"])
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority", fetch_date().alias("fetch_date"))


def events_lake(spark: SparkSession, sf: str) -> str:
    """raw/feed/events/2024-02-01/*: one JSON list of nested records per 500 events."""
    def build(root: str) -> None:
        damaged = F.when(F.col("event_id") % 13 == 0, "n/a").when(F.col("event_id") % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
        kind = F.when(F.col("event_id") % 19 != 0, F.col("event_type"))
        record = F.struct(
            "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
            F.struct(F.col("user_id").alias("id"), kind.alias("kind")).alias("user"),
            damaged.alias("value"), F.from_json("props", "struct<k int>").alias("props"),
            (F.col("event_id") % 2 == 0).alias("even"))
        lists = t(spark, sf, "events").groupBy((F.col("event_id") / 500).cast("bigint").alias("g")).agg(
            F.to_json(F.collect_list(record)).alias("value"))
        lists.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/raw/feed/events/2024-02-01")

    return lake_of(spark, sf, "events-lake", build)


@query("json_scan", "SELECT count(*) AS n_records, count(DISTINCT event_id) AS n_events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events")
def json_scan(spark, sf):
    rows = scan_json(spark, f"{events_lake(spark, sf)}/raw/feed/events/*/*")
    event = F.variant_get("record", "$.event_id", "bigint")
    return rows.agg(F.count("*").alias("n_records"), F.countDistinct(event).alias("n_events"), F.sum(event).alias("id_sum"))


EVENT_SCHEMA = {
    "event_id": ("int", "event_id"), "ts": ("timestamp", "ts"), "user_id": ("int", "user.id"), "kind": ("string", "user.kind"),
    "value": ("float", "value"), "k": ("int", "props.k"), "even": ("bool", "even"), "user": ("string", "user"),
}


def clean_events(spark, sf):
    return clean_json(scan_json(spark, f"{events_lake(spark, sf)}/raw/feed/events/*/*"), EVENT_SCHEMA)


_EVENT_VALUE = "CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN NULL ELSE value END"


@query("clean_typed_json", f"""
    SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, CASE WHEN event_id % 19 <> 0 THEN event_type END AS kind,
           {_EVENT_VALUE} AS value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 2 = 0 AS even,
           CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS n_bad
    FROM events""")
def clean_typed_json(spark, sf):
    rows = clean_events(spark, sf)
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "user_id", "kind", "value", "k", "even",
                       F.size("_bad").alias("n_bad"))


@query("clean_json_bad_counts", """
    SELECT count(*) AS rows_in, count(*) AS rows_out, count(*) FILTER (WHERE event_id % 13 = 0) AS bad_value, count(*) AS bad_user,
           CAST(0 AS BIGINT) AS bad_kind FROM events""")
def clean_json_bad_counts(spark, sf):
    return bad_value_counts(clean_events(spark, sf), ["value", "user", "kind"])


CUSTOMER_SCHEMA = {"c_custkey": "int", "c_name": "string", "c_acctbal": "float", "c_nationkey": "int", "since": "timestamp", "active": "bool"}


def customer_lake(spark: SparkSession, sf: str) -> str:
    """raw/shop/customers/2024-03-01/*.csv with blanks, padding and values that do not fit."""
    def build(root: str) -> None:
        k = F.col("c_custkey")
        text = t(spark, sf, "customer").select(
            k.cast("string").alias("c_custkey"), F.lit("dropped").alias("remark"),
            F.concat(F.lit("  "), "c_name", F.lit("\t ")).alias("c_name"),
            F.when(k % 10 == 3, "n/a").when(k % 10 == 4, " ").when(k % 10 == 5, F.concat(F.col("c_acctbal").cast("string"), F.lit("d")))
            .otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
            F.when(k % 7 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit(".5"))).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey"),
            F.when(k % 11 == 0, "2022-13-01").when(k % 11 == 1, "2022").when(k % 11 == 2, "2022-01-05")
            .otherwise("2022-01-05T12:30:00+02:00").alias("since"),
            F.when(k % 3 == 0, "TRUE").when(k % 3 == 1, "0").otherwise("yes").alias("active"))
        write_csv(text, f"{root}/raw/shop/customers/2024-03-01")

    return lake_of(spark, sf, "customer-lake", build)


def clean_customers(spark, sf):
    rows = scan_csv(spark, f"{customer_lake(spark, sf)}/raw/shop/customers/*/*.csv", list(CUSTOMER_SCHEMA))
    return clean(rows, CUSTOMER_SCHEMA)


@query("clean_typed_csv", """
    SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 IN (3, 4, 5) THEN NULL ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS c_nationkey,
           CASE WHEN c_custkey % 11 IN (0, 1) THEN NULL WHEN c_custkey % 11 = 2 THEN '2022-01-05 00:00:00' ELSE '2022-01-05 10:30:00' END AS since,
           CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS active
    FROM customer""")
def clean_typed_csv(spark, sf):
    return clean_customers(spark, sf).select(
        "c_custkey", "c_name", "c_acctbal", "c_nationkey", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "active")


@query("clean_bad_value_counts", """
    SELECT count(*) AS rows_in, count(*) AS rows_out, CAST(0 AS BIGINT) AS bad_c_custkey, CAST(0 AS BIGINT) AS bad_c_name,
           count(*) FILTER (WHERE c_custkey % 10 IN (3, 5)) AS bad_c_acctbal, count(*) FILTER (WHERE c_custkey % 7 = 0) AS bad_c_nationkey,
           count(*) FILTER (WHERE c_custkey % 11 IN (0, 1)) AS bad_since, count(*) FILTER (WHERE c_custkey % 3 = 2) AS bad_active
    FROM customer""")
def clean_bad_value_counts(spark, sf):
    return bad_value_counts(clean_customers(spark, sf), CUSTOMER_SCHEMA)


@query("clean_write_report", """
    SELECT 'whole' AS run, count(*) AS rows_in, count(*) AS rows_out, count(*) FILTER (WHERE c_custkey % 10 IN (3, 5)) AS bad_c_acctbal,
           count(*) FILTER (WHERE c_custkey % 7 = 0) AS bad_c_nationkey, true AS whole FROM customer
    UNION ALL SELECT 'lossy', count(*), count(*) FILTER (WHERE c_custkey % 97 <> 0), count(*) FILTER (WHERE c_custkey % 97 <> 0 AND c_custkey % 10 IN (3, 5)),
           count(*) FILTER (WHERE c_custkey % 97 <> 0 AND c_custkey % 7 = 0), count(*) FILTER (WHERE c_custkey % 97 = 0) = 0 FROM customer""")
def clean_write_report(spark, sf):
    """Counted while the rows are written, at the scan and at the writer; the second run loses rows on the way, which must show."""
    def run(name, project):
        records = scan_csv(spark, f"{customer_lake(spark, sf)}/raw/shop/customers/*/*.csv", list(CUSTOMER_SCHEMA))
        r = write_clean_reported(records, project, CUSTOMER_SCHEMA, scratch_dir(spark, "clean"), "shop", "customers")
        return name, r.rows_in, r.rows_out, r.bad_values.get("c_acctbal", 0), r.bad_values.get("c_nationkey", 0), r.whole

    runs = [run("whole", lambda df: clean(df, CUSTOMER_SCHEMA)), run("lossy", lambda df: clean(df, CUSTOMER_SCHEMA).filter("c_custkey % 97 <> 0"))]
    return spark.createDataFrame(runs, "run string, rows_in bigint, rows_out bigint, bad_c_acctbal bigint, bad_c_nationkey bigint, whole boolean")


@query("clean_layer_report", """
    SELECT * FROM (
      SELECT '2024-03-01' AS fetch_date, 'c_acctbal' AS "column", count(*) FILTER (WHERE c_custkey % 10 IN (3, 5)) AS bad FROM customer
      UNION ALL SELECT '2024-03-01', 'c_nationkey', count(*) FILTER (WHERE c_custkey % 7 = 0) FROM customer
      UNION ALL SELECT '2024-03-01', 'since', count(*) FILTER (WHERE c_custkey % 11 IN (0, 1)) FROM customer
      UNION ALL SELECT '2024-03-01', 'active', count(*) FILTER (WHERE c_custkey % 3 = 2) FROM customer) WHERE bad > 0""")
def clean_layer_report(spark, sf):
    """Written to the clean layer first: the report comes from the stored rows."""
    lake = scratch_dir(spark, "clean")
    write_clean(clean_customers(spark, sf), lake, "shop", "customers")
    rows = read_clean(spark, lake, "shop", "customers", {n: TYPES[v] for n, v in CUSTOMER_SCHEMA.items()})
    return clean_report(rows, CUSTOMER_SCHEMA, ["fetch_date"])


@query("clean_layer_positions", "SELECT count(*) AS n_rows, count(*) AS n_positions, true AS named FROM customer")
def clean_layer_positions(spark, sf):
    target = write_clean(clean_customers(spark, sf), scratch_dir(spark, "clean"), "shop", "customers")
    files = scan_clean(spark, f"{target}/*/*").groupBy("_file_name").agg(
        F.count("*").alias("rows"), (F.max("_file_row") + 1).alias("positions"))
    return files.agg(F.sum("rows").alias("n_rows"), F.sum("positions").alias("n_positions"),
                     F.bool_and(F.col("_file_name").endswith(".parquet")).alias("named"))


@query("parse_values", """
    SELECT p_partkey, p_type AS as_string, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS as_int,
           CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_retailprice ELSE p_retailprice * 1000 END AS as_float,
           CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 = 1 THEN false END AS as_bool,
           CASE WHEN p_size % 5 = 0 THEN NULL
                ELSE strftime(DATE '2020-01-01' + CAST(p_size AS INTEGER), '%Y-%m-%d') || CASE p_size % 5 WHEN 1 THEN ' 00:00' WHEN 2 THEN ' 05:06' WHEN 3 THEN ' 03:06' ELSE ' 05:00' END END AS as_timestamp
    FROM part""")
def parse_values(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice").cast("string")
    d = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), size), "yyyy-MM-dd")
    texts = {
        "string": F.concat(F.lit("　 "), "p_type", F.lit("\r\n")),
        "int": F.when(size % 2 == 0, F.concat(F.lit(" +"), size.cast("string"))).otherwise(F.concat(size.cast("string"), F.lit(".0"))),
        "float": F.when(size % 3 == 0, F.concat(price, F.lit("f"))).when(size % 3 == 1, price).otherwise(F.concat(price, F.lit("e3"))),
        "bool": F.when(size % 4 == 0, "tRuE").when(size % 4 == 1, " 0 ").otherwise("y"),
        "timestamp": F.when(size % 5 == 0, F.lit("05:00")).when(size % 5 == 1, d).when(size % 5 == 2, F.concat(d, F.lit("T05:06Z")))
        .when(size % 5 == 3, F.concat(d, F.lit(" 05:06:00+02:00"))).otherwise(F.concat(d, F.lit("T05"))),
    }
    values = {n: parse(blank_to_null(c), n) for n, c in texts.items()}
    values["timestamp"] = F.date_format(values["timestamp"], "yyyy-MM-dd HH:mm")
    rows = t(spark, sf, "part").select("p_partkey", *[c.alias(f"as_{n}") for n, c in values.items()])
    return rows


@query("payload_validation", """
    SELECT 'good' AS kind, true AS ok, count(*) AS rows FROM customer
    UNION ALL SELECT 'markup', false, NULL""")
def payload_validation(spark, sf):
    """Customer tables are good replies; web pages stand for the markup a failing server sends instead."""
    def build(root: str) -> None:
        write_csv(t(spark, sf, "customer"), f"{root}/raw/reply/mixed/2024-04-01")
        t(spark, sf, "pages").select("html").write.text(f"{root}/raw/reply/mixed/2024-04-02")

    lake = lake_of(spark, sf, "reply-lake", build)
    judged = validate_payloads(spark, f"{lake}/raw/reply/mixed/*/*", "c_custkey")
    kind = F.when(fetch_date() == "2024-04-01", "good").otherwise("markup")
    return judged.groupBy(kind.alias("kind")).agg(F.bool_and("ok").alias("ok"), F.sum("rows").alias("rows"))


@query("ask_parquet_glob", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty
    FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY ALL""")
def ask_parquet_glob(spark, sf):
    return read_only(spark, f"""
        SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty
        FROM {parquet_glob(f"{sf.rstrip('/')}/line*.parquet")} WHERE l_shipdate < TIMESTAMP_NTZ '2000-01-01 00:00:00'
        GROUP BY l_returnflag, l_linestatus -- a trailing remark is harmless""")


@query("dataset_registry", f"""
    SELECT o_orderpriority, count(*) AS n, CAST({len(DATASETS)} AS BIGINT) AS datasets, CAST(0 AS BIGINT) AS known FROM orders GROUP BY 1""")
def dataset_registry(spark, sf):
    """Folders of the lake against the registry: orders come from a source nobody registered."""
    known = registry_frame(spark)
    orders = t(spark, sf, "orders").withColumns({"source": F.lit("shop"), "dataset": F.lit("orders")})
    marked = orders.join(known.select("source", "dataset", "format"), ["source", "dataset"], "left")
    return marked.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.lit(known.count()).alias("datasets"), F.count("format").alias("known"))


def _mixed_lake(spark: SparkSession, sf: str) -> str:
    """Folders of three sources; the registry knows two of them."""
    def build(root: str) -> None:
        for table, folder in (("customer", "gaia/nearby-stars"), ("supplier", "exoplanets/planets"), ("nation", "shop/nations")):
            t(spark, sf, table).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/raw/{folder}/2024-05-01")

    return lake_of(spark, sf, "mixed-lake", build)


@query("registry_of_folders", """
    SELECT 'gaia' AS source, 'nearby-stars' AS dataset, 'csv' AS format, 'astro.nearby_stars' AS "table", 1 AS key_columns, count(*) AS n FROM customer
    UNION ALL SELECT 'exoplanets', 'planets', 'csv', 'astro.exoplanets', 1, count(*) FROM supplier
    UNION ALL SELECT 'shop', 'nations', NULL, NULL, NULL, count(*) FROM nation""")
def registry_of_folders(spark, sf):
    """What the registry says of every folder that is there, known or not, and how many records lie in it."""
    lines = spark.read.text(f"{_mixed_lake(spark, sf)}/raw/*/*/*/*").select(F.col("_metadata.file_path").alias("path"))
    there = with_path_parts(lines).groupBy("source", "dataset").agg(F.count("*").alias("n"))
    known = registry_frame(spark).withColumn("key_columns", F.size("key"))
    return there.join(known, ["source", "dataset"], "left").select("source", "dataset", "format", "table", "key_columns", "n")


# -- registration and completeness --------------------------------------------------------------------------------

@query("register_manifest", """
    SELECT strftime(o_orderdate, '%Y-%m') || '.csv' AS path, count(*) AS size_bytes,
           CASE WHEN min(o_orderdate) >= TIMESTAMP '1998-01-01' THEN 'late' ELSE 'early' END AS wave,
           CAST(CASE WHEN min(o_orderdate) >= TIMESTAMP '1998-01-01' THEN 1 ELSE 0 END AS BIGINT) AS extras
    FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')""")
def register_manifest(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM")
    files = t(spark, sf, "orders").groupBy(F.concat(month, F.lit(".csv")).alias("path")).agg(F.count("*").alias("size_bytes"))
    extra = F.create_map(F.lit("pages"), F.lit("1"), F.lit("size_bytes"), F.lit("0"))
    early = files.filter("path < '1998'").withColumns({"wave": F.lit("early"), "extra": F.create_map().cast("map<string,string>")})
    late = files.filter("path >= '1998'").withColumns({"wave": F.lit("late"), "extra": extra})
    return register_raw(late, early).select("path", "size_bytes", "wave", F.size("extra").cast("bigint").alias("extras"))


@query("fetch_completeness", """
    WITH m AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(o_custkey AS VARCHAR) AS path, n AS rows, CASE o_custkey % 4 WHEN 0 THEN n >= 10 WHEN 1 THEN n < 12 ELSE false END AS complete,
           CASE WHEN o_custkey % 4 = 0 AND n < 10 THEN 'fewer_than_expected' WHEN o_custkey % 4 = 1 AND n >= 12 THEN 'limit_reached'
                WHEN o_custkey % 4 >= 2 THEN 'unverified' ELSE 'complete' END AS reason
    FROM m""")
def completeness(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_custkey")
    manifest = rows.distinct().select(
        "path", F.when(F.col("o_custkey") % 4 == 0, 10).alias("expected_rows"), F.when(F.col("o_custkey") % 4 == 1, 12).alias("row_limit"))
    return fetch_completeness(rows, manifest)


@query("page_audit", """
    WITH p AS (SELECT user_id AS "fetch", CAST(date_part('day', ts) AS BIGINT) - 1 AS page, count(*) AS n, CAST(sum(event_id) AS VARCHAR) AS h
               FROM events GROUP BY 1, 2),
    full_p AS (SELECT fp.f AS "fetch", fp.page, coalesce(p.n, 0) AS n, coalesce(p.h, '') AS h
               FROM (SELECT * FROM (SELECT DISTINCT "fetch" AS f FROM p) CROSS JOIN (SELECT range AS page FROM range(0, 31))) fp
               LEFT JOIN p ON p."fetch" = fp.f AND p.page = fp.page),
    j AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN h = lag(h) OVER (PARTITION BY "fetch" ORDER BY page) THEN 'repeated' WHEN n < 2 THEN 'short' END AS ending
          FROM full_p),
    e AS (SELECT "fetch", min(page) FILTER (WHERE ending IS NOT NULL) AS stop, max(page) AS last_page FROM j GROUP BY 1)
    SELECT j."fetch", count(*) AS pages, CAST(sum(CASE WHEN ending IN ('empty', 'repeated') THEN 0 ELSE n END) AS BIGINT) AS rows_kept,
           coalesce(max(CASE WHEN page = stop THEN ending END) IN ('empty', 'short'), false) AS complete,
           CASE WHEN max(CASE WHEN page = stop THEN ending END) IN ('empty', 'short') THEN 'complete'
                WHEN max(CASE WHEN page = stop THEN ending END) = 'repeated' THEN 'offset_ignored' ELSE 'page_cap' END AS reason
    FROM j JOIN e USING ("fetch") WHERE stop IS NULL OR page <= stop GROUP BY j."fetch" """)
def pages_of_fetches(spark, sf):
    """A user's events per day of a month stand for the pages of one fetch, more than the cap; days without events are empty pages."""
    filled = t(spark, sf, "events").groupBy(F.col("user_id").alias("fetch"), (F.dayofmonth("ts") - 1).cast("bigint").alias("page")).agg(
        F.count("*").alias("n"), F.sum("event_id").cast("string").alias("h"))
    every = filled.select("fetch").distinct().withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(30)).cast("array<bigint>")))
    pages = every.join(filled, ["fetch", "page"], "left").select("fetch", "page", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("h", F.lit("")).alias("h"))
    return page_audit(pages, "fetch", "page", "n", "h", limit=2, cap=20)


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", content_hash("text").alias("sha256"))


@query("band_selection", """
    SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 920 AND p_retailprice <= 960.5 AND p_retailprice / p_size > 30
    ORDER BY p_retailprice DESC, p_partkey LIMIT 100""")
def band_selection(spark, sf):
    return band_select(t(spark, sf, "part"), "p_retailprice", 920.0, 960.5, "p_size", 30.0, 100, tie="p_partkey").select("p_partkey", "p_retailprice")


@query("window_names", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_date,
           CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS end_date,
           CASE WHEN o_orderkey % 5 <> 0 THEN 'areas-' || CAST(o_custkey AS VARCHAR) END AS region
    FROM orders""")
def window_names(spark, sf):
    key = F.col("o_orderkey")
    name = F.concat(day("o_orderdate"), F.when(key % 5 == 0, F.lit("-")).otherwise(F.lit("_")), day(F.date_add(F.to_date("o_orderdate"), 30)),
                    F.lit("_areas-"), F.col("o_custkey").cast("string"), F.lit(".json"))
    start, end, region = parse_window_name("name")
    return t(spark, sf, "orders").select("o_orderkey", name.alias("name")).select(
        "o_orderkey", start.cast("string").alias("start_date"), end.cast("string").alias("end_date"), region.alias("region"))
