"""Joins, aggregates, windows, ordered results, set operations, scalar functions and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.scalars import angular_sep, shells_between, trailing_id, unit_vector
from strata.operators.aggregates import base_rate, count_rows, count_where, group_stats, median_of, ranking_metrics, worst_severity
from strata.operators.joins import (
    attach_errors, count_existing, join_on_name, join_on_text_id, label_members, lookup_default, without_keys,
)
from strata.operators.sets import compare_tables, concat_pages, union_by_name
from strata.operators.spatial import band_neighbours, sky_radius_join
from strata.operators.topk import by_weight, examples, rank_candidates, top_k
from strata.operators.windows import last_per_key, latest_wins, nearest_per_entity, with_candidate_count
from strata.plans.quality import ALL_RULES, Check, rule_counts, rules_for, status_frame
from strata.workload.base import planets, planets_sql, positions, positions_sql, query, r6, stars, stars_sql, t

# -- joins --------------------------------------------------------------------------------------------------------

@query("join_text_id", """
    SELECT c.c_name, count(*) AS n_orders, round(max(o.o_totalprice), 2) AS max_price
    FROM customer c JOIN orders o ON o.o_custkey = TRY_CAST(nullif(regexp_extract(c.c_name, '([0-9]+)\\s*$', 1), '') AS BIGINT)
    WHERE c.c_custkey % 3 <> 0 GROUP BY 1""")
def join_text_id(spark, sf):
    names = t(spark, sf, "customer").select(F.when(F.col("c_custkey") % 3 == 0, "no number").otherwise(F.col("c_name")).alias("c_name"))
    orders = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.max("o_totalprice"), 2).alias("max_price"))
    return join_on_text_id(names, "c_name", orders, "o_custkey").select("c_name", "n_orders", "max_price")


@query("trailing_ids", """
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey WHEN 2 THEN NULL ELSE NULL END AS id FROM supplier""")
def trailing_ids(spark, sf):
    k = F.col("s_suppkey").cast("string")
    text = (F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("Gaia DR3 "), k)).when(F.col("s_suppkey") % 4 == 1, F.concat(k, F.lit("  ")))
            .when(F.col("s_suppkey") % 4 == 2, F.concat(k, F.lit("x"))).otherwise(F.concat(F.lit("9999999999999999999"), k)))
    return t(spark, sf, "supplier").select("s_suppkey", trailing_id(text).alias("id"))


@query("join_by_name", """
    SELECT n_name, count(*) AS customers, round(avg(c_acctbal), 6) AS balance
    FROM customer JOIN nation ON n_name = 'NATION_' || CAST(c_nationkey AS VARCHAR) GROUP BY 1""")
def join_by_name(spark, sf):
    customers = t(spark, sf, "customer").withColumn("n_name", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    joined = join_on_name(customers, t(spark, sf, "nation").select("n_name"), "n_name")
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), r6(F.avg("c_acctbal")).alias("balance"))


@query("left_join_errors", """
    SELECT p_partkey, p_retailprice, e.price_error FROM part LEFT JOIN
      (SELECT l_partkey, round(stddev_pop(l_extendedprice), 6) AS price_error FROM lineitem WHERE l_quantity > 45 GROUP BY 1) e
      ON l_partkey = p_partkey""")
def left_join_errors(spark, sf):
    errors = t(spark, sf, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        r6(F.stddev_pop("l_extendedprice")).alias("price_error"))
    return attach_errors(t(spark, sf, "part").select("p_partkey", "p_retailprice"), errors, "p_partkey")


@query("count_existing_keys", "SELECT count(*) AS updated FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def count_existing_keys(spark, sf):
    incoming = t(spark, sf, "orders").filter("o_orderkey % 3 = 0").withColumnRenamed("o_orderkey", "k")
    return count_existing(incoming, t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k"), ["k"])


@query("rows_without_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def rows_without_keys(spark, sf):
    returned = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return without_keys(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), returned, "o_orderkey")


@query("member_labels", """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS label FROM orders""")
def member_labels(spark, sf):
    members = t(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return label_members(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", members)


@query("lookup_with_default", """
    SELECT c_custkey, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000), -1) AS best FROM customer""")
def lookup_with_default(spark, sf):
    best = t(spark, sf, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return lookup_default(t(spark, sf, "customer").select("c_custkey"), best, "c_custkey", "best", -1.0)


def sep_sql() -> str:
    """Arcseconds between `spot` and `star` in the year of `epoch`, motions given in milliarcseconds a year from 2016 on."""
    drift = "(epoch.year - 2016) / 3.6e6"
    north = f'(spot."dec" - star."dec" - ifnull(star.pmdec, 0) * {drift})'
    turned = f'(spot.ra - star.ra - ifnull(star.pmra, 0) * {drift} / cos(radians(star."dec")))'
    east = f'(({turned} - 360 * round({turned} / 360)) * cos(radians(spot."dec")))'
    return f"3600 * sqrt({north} * {north} + {east} * {east})"


@query("sky_radius_pairs", f"""
    SELECT spot.pl_name, star.source_id, round(min({sep_sql()}), 5) AS sep
    FROM ({positions_sql()}) AS spot, ({stars_sql()}) AS star, (VALUES (2016.0), (2000.0)) AS epoch(year)
    GROUP BY ALL HAVING min({sep_sql()}) <= 10""")
def sky_radius_pairs(spark, sf):
    points, sky = positions(spark, sf), stars(spark, sf)
    pairs = sky_radius_join(points, sky, 10.0, pid="pl_name", sid="source_id")
    return pairs.select("pl_name", "source_id", F.round("sep", 5).alias("sep"))


# Huge numbers on either side: no position, and a motion that leads nowhere.
_FAR_SPOT = "CASE WHEN dec > 60 THEN CAST(1e300 AS DOUBLE) WHEN dec < -60 THEN CAST('NaN' AS DOUBLE) ELSE dec END"
_FAR_STAR = "CASE WHEN source_id % 50 = 0 THEN CAST(1e300 AS DOUBLE) ELSE dec END"
_FAR_MOTION = "CASE WHEN source_id % 51 = 0 THEN CAST(-1e300 AS DOUBLE) ELSE pmdec END"


@query("sky_radius_pairs_odd_values", f"""
    SELECT spot.pl_name, star.source_id, round(min({sep_sql()}), 5) AS sep
    FROM (SELECT pl_name, ra, {_FAR_SPOT} AS dec FROM ({positions_sql()}) WHERE dec BETWEEN -60 AND 60) AS spot,
         (SELECT source_id, ra, dec, pmra, {_FAR_MOTION} AS pmdec FROM ({stars_sql()}) WHERE source_id % 50 <> 0) AS star, (VALUES (2016.0), (2000.0)) AS epoch(year)
    GROUP BY ALL HAVING min({sep_sql()}) <= 10""")
def sky_radius_pairs_odd_values(spark, sf):
    points = positions(spark, sf).withColumn("dec", F.expr(_FAR_SPOT))
    sky = stars(spark, sf).withColumns({"dec": F.expr(_FAR_STAR), "pmdec": F.expr(_FAR_MOTION)})
    pairs = sky_radius_join(points, sky, 10.0, pid="pl_name", sid="source_id")
    return pairs.select("pl_name", "source_id", F.round("sep", 5).alias("sep"))


@query("band_neighbours", """
    SELECT a.p_partkey, count(*) - 1 AS neighbours FROM part a JOIN part b
      ON abs(a.p_size - b.p_size) <= 1 AND abs(a.p_retailprice - b.p_retailprice) <= 0.5 GROUP BY 1 HAVING count(*) - 1 < 5""")
def neighbours_in_bands(spark, sf):
    return band_neighbours(t(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice", 1.0, 0.5, 5)


_ODD_SIZE = """CASE p_partkey % 40 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE)
    WHEN 3 THEN NULL WHEN 4 THEN CAST(1e300 AS DOUBLE) WHEN 5 THEN CAST(-1.7e308 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END"""
_ODD_PRICE = "CASE p_partkey % 41 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST(-1e300 AS DOUBLE) WHEN 2 THEN CAST(1e15 AS DOUBLE) ELSE p_retailprice END"


@query("band_neighbours_odd_values", f"""
    WITH p AS (SELECT p_partkey, {_ODD_SIZE} AS x, {_ODD_PRICE} AS y FROM part)
    SELECT a.p_partkey, count(*) - 1 AS neighbours FROM p AS a JOIN p AS b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 0.5 GROUP BY 1 HAVING count(*) - 1 < 5""")
def neighbours_in_bands_with_odd_values(spark, sf):
    parts = t(spark, sf, "part").selectExpr("p_partkey", f"{_ODD_SIZE} AS x", f"{_ODD_PRICE} AS y")
    return band_neighbours(parts, "p_partkey", "x", "y", 1.0, 0.5, 5)


# -- aggregates ---------------------------------------------------------------------------------------------------

@query("count_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def count_by_group(spark, sf):
    return count_rows(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("count_all", "SELECT count(*) AS n FROM lineitem")
def count_all(spark, sf):
    return count_rows(t(spark, sf, "lineitem"))


@query("conditional_counts", """
    SELECT count(*) AS total, count(*) FILTER (WHERE l_discount > 0.05 AND l_tax < 0.04) AS cheap, count(*) FILTER (WHERE l_returnflag = 'R') AS returned
    FROM lineitem""")
def conditional_counts(spark, sf):
    return count_where(t(spark, sf, "lineitem"), {"cheap": "l_discount > 0.05 AND l_tax < 0.04", "returned": F.col("l_returnflag") == "R"})


@query("exact_median", "SELECT count(l_extendedprice) AS n, median(l_extendedprice) AS median FROM lineitem")
def exact_median(spark, sf):
    return median_of(t(spark, sf, "lineitem"), "l_extendedprice")


@query("exact_median_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_extendedprice / l_quantity) AS median FROM lineitem GROUP BY 1, 2")
def exact_median_by_group(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    return median_of(rows, "unit", ["l_returnflag", "l_linestatus"])


@query("group_statistics", """
    SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest,
           CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events) GROUP BY 1""")
def group_statistics(spark, sf):
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    rows = t(spark, sf, "events").select("event_type", value.alias("value"), value.cast("decimal(18,2)").alias("exact"))
    out = group_stats(rows, ["event_type"], {"n": ("value", "count"), "mean": ("value", "avg"), "lowest": ("value", "min"),
                                            "highest": ("value", "max"), "total": ("exact", "sum")})
    return out.withColumns({"mean": r6("mean"), "total": F.col("total").cast("double")})


_AP = """
    WITH e AS (SELECT floor(value) AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events),
    g AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM e GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC)),
    tot AS (SELECT sum(pos) AS p, sum(neg) AS q FROM g)"""


@query("ranking_metrics", _AP + """
    SELECT CAST(any_value(p + q) AS BIGINT) AS n, CAST(any_value(p) AS BIGINT) AS positives,
           round(sum(neg * (tp - pos + pos / 2.0)) / any_value(p * q), 9) AS auc,
           round(sum(pos * (tp / (tp + fp))) / any_value(p), 9) AS avg_precision, round(any_value(p / (p + q)), 9) AS base_rate
    FROM c, tot""")
def ranking(spark, sf):
    rows = t(spark, sf, "events").select(F.floor("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    m = ranking_metrics(rows, "score", "y")
    return m.select("n", "positives", *[F.round(c, 9).alias(c) for c in ("auc", "avg_precision", "base_rate")])


@query("label_base_rate", "SELECT round(avg(quality), 9) AS base_rate FROM labels")
def label_base_rate(spark, sf):
    return base_rate(t(spark, sf, "labels"), "quality").select(F.round("base_rate", 9).alias("base_rate"))


# -- windows ------------------------------------------------------------------------------------------------------

_LINE = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("dedupe_last_wins", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(c + " DESC" for c in _LINE)}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_last_wins(spark, sf):
    rows = last_per_key(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


_FETCHES = """
    WITH f AS (SELECT o_orderkey, o_totalprice AS price, 'b.csv' AS path, TIMESTAMP '2024-01-01 00:00:00' AS fetched, o_orderkey AS pos FROM orders
    UNION ALL SELECT o_orderkey, o_totalprice + 1, 'a.csv', TIMESTAMP '2024-01-02 00:00:00', o_orderkey FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, o_totalprice + 2, 'c.csv', TIMESTAMP '2024-01-02 00:00:00', o_orderkey FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey, o_totalprice + 3, 'c.csv', TIMESTAMP '2024-01-02 00:00:00', -o_orderkey - 1 FROM orders WHERE o_orderkey % 8 = 0)"""


@query("latest_fetch_wins", _FETCHES + """
    SELECT o_orderkey, price, path FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY fetched DESC, path DESC, pos DESC) AS rn FROM f) WHERE rn = 1""")
def latest_fetch_wins(spark, sf):
    o = t(spark, sf, "orders")

    def fetch(every, plus, path, at, pos):
        return o.filter(F.col("o_orderkey") % every == 0).select(
            "o_orderkey", (F.col("o_totalprice") + plus).alias("price"), F.lit(path).alias("path"),
            F.lit(at).cast("timestamp").alias("_fetched_at"), pos.alias("_row_pos"))

    key = F.col("o_orderkey")
    copies = union_by_name(fetch(1, 0, "b.csv", "2024-01-01", key), fetch(2, 1, "a.csv", "2024-01-02", key),
                           fetch(4, 2, "c.csv", "2024-01-02", key), fetch(8, 3, "c.csv", "2024-01-02", -key - 1))
    return latest_wins(copies, "o_orderkey").select("o_orderkey", "price", "path")


@query("nearest_per_entity", """
    SELECT o_custkey, o_orderkey, round(d, 6) AS d FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS rn FROM
        (SELECT o_custkey, o_orderkey, abs(o_totalprice - 250000) AS d FROM orders)) WHERE rn = 1""")
def nearest_entity(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.abs(F.col("o_totalprice") - 250000).alias("d"))
    return nearest_per_entity(rows, "o_custkey", "d", "o_orderkey").withColumn("d", r6("d"))


@query("candidate_counts", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS candidates FROM orders")
def candidate_counts(spark, sf):
    return with_candidate_count(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


# -- ordered results ----------------------------------------------------------------------------------------------

@query("top_descending", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_discount * l_discount + l_tax * l_tax) * l_extendedprice / l_quantity, 6) AS ratio
    FROM lineitem ORDER BY sqrt(l_discount * l_discount + l_tax * l_tax) * l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50""")
def top_descending(spark, sf):
    ratio = F.sqrt(F.col("l_discount") * F.col("l_discount") + F.col("l_tax") * F.col("l_tax")) * F.col("l_extendedprice") / F.col("l_quantity")
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio.alias("ratio"))
    best = top_k(rows, "ratio", 50, desc=True, tie=["l_orderkey", "l_linenumber", "l_partkey"])
    return best.withColumn("ratio", r6("ratio"))


@query("top_ascending_in_window", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1999-01-01'
    ORDER BY o_totalprice, o_orderkey LIMIT 25""")
def top_ascending_in_window(spark, sf):
    inside = t(spark, sf, "orders").filter("o_orderdate > TIMESTAMP_NTZ '1998-01-01 00:00:00' AND o_orderdate <= TIMESTAMP_NTZ '1999-01-01 00:00:00'")
    return top_k(inside, "o_totalprice", 25, tie="o_orderkey").select("o_orderkey", "o_totalprice")


@query("top_by_count_then_id", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 40")
def top_by_count_then_id(spark, sf):
    return top_k(count_rows(t(spark, sf, "orders"), ["o_custkey"]), ["n", "o_custkey"], 40)


@query("ranked_candidates", "SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 60")
def ranked_candidates(spark, sf):
    return rank_candidates(t(spark, sf, "events").filter("event_type = 'error'").select("event_id", "value"), "value", "event_id", 60)


@query("rule_examples", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 ORDER BY o_orderkey LIMIT 3")
def rule_examples(spark, sf):
    return examples(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice > 450000", 3, "o_orderkey")


@query("weights_by_size", "SELECT o_orderpriority AS feature, round(corr(o_totalprice, o_custkey), 9) AS weight FROM orders GROUP BY 1")
def weights_by_size(spark, sf):
    rows = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("feature")).agg(F.round(F.corr("o_totalprice", F.col("o_custkey").cast("double")), 9).alias("weight"))
    return by_weight(rows)


# -- sets ---------------------------------------------------------------------------------------------------------

@query("union_of_routes", """
    SELECT 'customer' AS route, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2
    UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def union_of_routes(spark, sf):
    def route(table, column):
        return t(spark, sf, table).groupBy(F.lit(table).alias("route"), F.col(column).alias("nation")).agg(F.count("*").alias("n"))

    return union_by_name(route("customer", "c_nationkey"), route("supplier", "s_nationkey").select("n", "nation", "route"))


@query("table_diff", """
    WITH b AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 20 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
               FROM customer WHERE c_custkey % 33 <> 0),
    a AS (SELECT c_custkey, c_name, c_acctbal FROM customer)
    SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,
           (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a,
           (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, false AS same""")
def table_diff(spark, sf):
    a = t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    b = a.filter(k % 33 != 0).withColumn("c_acctbal", F.when(k % 50 == 0, F.lit(None)).when(k % 20 == 0, v + 1).otherwise(v))
    return compare_tables(a, b)


@query("table_diff_same", "SELECT count(*) AS rows_a, count(*) AS rows_b, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b, true AS same FROM lineitem")
def table_diff_same(spark, sf):
    line = t(spark, sf, "lineitem")
    return compare_tables(line, line.select(*reversed(line.columns)))


@query("concatenated_pages", "SELECT event_id, CAST(event_id // 100 AS BIGINT) AS page, event_id % 100 AS pos FROM events")
def concatenated_pages(spark, sf):
    rows = t(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 100).alias("page"), (F.col("event_id") % 100).alias("pos"))
    return concat_pages([rows.filter("page % 2 = 1"), rows.filter("page % 2 = 0")])


# -- scalar functions ---------------------------------------------------------------------------------------------

@query("scalar_functions", """
    SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log,
           least(c_acctbal, 100.0::DOUBLE) AS smaller, coalesce(nullif(c_nationkey, 3), -1) AS filled,
           round(cos(radians(CAST(c_custkey % 360 AS DOUBLE))), 6) AS cosine, c_custkey % 7 AS remainder, CAST(round(c_acctbal) AS BIGINT) AS whole
    FROM customer""")
def scalar_functions(spark, sf):
    b = F.col("c_acctbal")
    return t(spark, sf, "customer").select(
        "c_custkey", r6(F.sqrt(F.abs(b))).alias("root"), F.when(b > 0, r6(F.log10(b))).alias("log"), F.least(b, F.lit(100.0)).alias("smaller"),
        F.coalesce(F.nullif("c_nationkey", F.lit(3)), F.lit(-1)).alias("filled"),
        r6(F.cos(F.radians((F.col("c_custkey") % 360).cast("double")))).alias("cosine"), (F.col("c_custkey") % 7).alias("remainder"),
        F.round(b).cast("bigint").alias("whole"))


def _vec_sql(ra: str, dec: str) -> tuple[str, str, str]:
    return (f"cos(radians({dec})) * cos(radians({ra}))", f"cos(radians({dec})) * sin(radians({ra}))", f"sin(radians({dec}))")


_U, _V = _vec_sql("ra", '"dec"'), _vec_sql("ra + 0.001", '"dec" + 0.002')


@query("angular_separation", f"""
    SELECT source_id, round(degrees(2 * asin(least(1.0, sqrt({" + ".join(f"pow({a} - ({b}), 2)" for a, b in zip(_U, _V))}) / 2))) * 3600, 5) AS arcsec,
           round(hypot(ra, "dec"), 6) AS norm, greatest(ra, "dec") AS larger
    FROM ({stars_sql()})""".replace("hypot(ra, \"dec\")", 'sqrt(ra * ra + "dec" * "dec")'))
def angular_separation(spark, sf):
    u, v = unit_vector("ra", "dec"), unit_vector(F.col("ra") + 0.001, F.col("dec") + 0.002)
    return stars(spark, sf).select("source_id", F.round(angular_sep(u, v) * 3600, 5).alias("arcsec"), r6(F.hypot("ra", "dec")).alias("norm"),
                                   F.greatest("ra", "dec").alias("larger"))


@query("shell_edges", """
    WITH d AS (SELECT DISTINCT p_size FROM part), e AS (SELECT p_size AS near_pc, lead(p_size) OVER (ORDER BY p_size) AS far_pc FROM d)
    SELECT CAST(near_pc AS DOUBLE) AS near_pc, CAST(far_pc AS DOUBLE) AS far_pc, round(1000.0 / near_pc, 4) AS hi, round(1000.0 / far_pc, 4) AS lo
    FROM e WHERE far_pc IS NOT NULL""")
def edges_of_shells(spark, sf):
    """Sizes of parts stand for distances; there are at most fifty."""
    stops = sorted(float(r["p_size"]) for r in t(spark, sf, "part").select("p_size").distinct().collect())
    return shells_between(spark, stops).select("near_pc", "far_pc", "hi", "lo")


# -- quality ------------------------------------------------------------------------------------------------------

_CHECKS = [
    Check("huge", "shop.orders", "o_totalprice > 400000", "warning", "A very large order."),
    Check("negative", "shop.orders", "o_totalprice < 0", "error", "Prices are above zero."),
    Check("no_owner", "shop.customer", "nullif(c_nationkey, 3) = 3", "error", "Never true: NULL does not flag."),
    Check("in_debt", "shop.customer", "c_acctbal < 0", "error", "A negative balance."),
    Check("late", "shop.lineitem", "l_shipdate > TIMESTAMP_NTZ '2001-01-01 00:00:00'", "warning", "Shipped late."),
    Check("anything", "shop.missing", "true", "error", "The table does not exist."),
]


def _shop_counts(spark, sf):
    return rule_counts({f"shop.{n}": t(spark, sf, n) for n in ("orders", "customer", "lineitem")}, _CHECKS)


_SHOP = """
    SELECT 'huge' AS rule, 'shop.orders' AS "table", 'warning' AS severity, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 400000) AS flagged, false AS skipped FROM orders
    UNION ALL SELECT 'negative', 'shop.orders', 'error', count(*), count(*) FILTER (WHERE o_totalprice < 0), false FROM orders
    UNION ALL SELECT 'no_owner', 'shop.customer', 'error', count(*), 0, false FROM customer
    UNION ALL SELECT 'in_debt', 'shop.customer', 'error', count(*), count(*) FILTER (WHERE c_acctbal < 0), false FROM customer
    UNION ALL SELECT 'late', 'shop.lineitem', 'warning', count(*), count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2001-01-01'), false FROM lineitem
    UNION ALL SELECT 'anything', 'shop.missing', 'error', NULL, NULL, true"""


@query("quality_flags", _SHOP)
def quality_flags(spark, sf):
    return _shop_counts(spark, sf)


@query("quality_report", f"""
    SELECT rule, CASE WHEN skipped THEN 'skip' WHEN flagged = 0 THEN 'ok' WHEN severity = 'error' THEN 'ERROR' ELSE 'WARN' END AS status,
           CASE WHEN skipped THEN "table" || ' not found' ELSE CAST(flagged AS VARCHAR) || ' of ' || CAST(total AS VARCHAR) || ' rows' END AS text
    FROM ({_SHOP})""")
def quality_report(spark, sf):
    return status_frame(_shop_counts(spark, sf)).select("rule", "status", "text")


@query("quality_severity", f"""
    SELECT count(*) FILTER (WHERE flagged > 0 AND severity = 'error') AS errors, count(*) FILTER (WHERE flagged > 0 AND severity = 'warning') AS warnings,
           max(CASE WHEN flagged > 0 AND severity = 'error' THEN 2 WHEN flagged > 0 THEN 1 ELSE 0 END) AS code FROM ({_SHOP})""")
def quality_severity(spark, sf):
    return worst_severity(_shop_counts(spark, sf))


_GAPS = """SELECT user_id AS vessel_id, ts AS start, ts + to_hours(CAST(event_id % 5 - 1 AS INTEGER)) AS "end",
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 32651.93 ELSE value - 5 END AS duration_hours FROM events"""


@query("gap_rules", f"""
    SELECT 'end_before_start' AS rule, count(*) AS total, count(*) FILTER (WHERE "end" < start) AS flagged FROM ({_GAPS})
    UNION ALL SELECT 'non_positive_duration', count(*), count(*) FILTER (WHERE duration_hours <= 0) FROM ({_GAPS})
    UNION ALL SELECT 'missing_duration', count(*), count(*) FILTER (WHERE duration_hours IS NULL) FROM ({_GAPS})
    UNION ALL SELECT 'extreme_duration', count(*), count(*) FILTER (WHERE duration_hours > 8760) FROM ({_GAPS})""")
def gap_rules(spark, sf):
    hours = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 97 == 0, 32651.93).otherwise(F.col("value") - 5)
    gaps = t(spark, sf, "events").select(
        F.col("user_id").alias("vessel_id"), F.col("ts").alias("start"), F.expr("ts + make_dt_interval(0, CAST(event_id % 5 - 1 AS INT))").alias("end"),
        hours.alias("duration_hours"))
    return rule_counts({"ocean.gap_events": gaps}, rules_for("ocean")).select("rule", "total", "flagged")


_ASTRO = f"""
    SELECT 'impossible_position' AS rule, count(*) AS total, count(*) FILTER (WHERE ra < 0 OR ra >= 360 OR "dec" < -90 OR "dec" > 90) AS flagged FROM ({stars_sql()})
    UNION ALL SELECT 'no_valid_parallax', count(*), count(*) FILTER (WHERE parallax IS NULL OR parallax <= 0) FROM ({stars_sql()})
    UNION ALL SELECT 'weak_parallax', count(*), count(*) FILTER (WHERE parallax > 0 AND parallax_error > 0 AND parallax / parallax_error < 10) FROM ({stars_sql()})
    UNION ALL SELECT 'no_colour', count(*), count(*) FILTER (WHERE bp_rp IS NULL) FROM ({stars_sql()})"""


@query("star_rules", _ASTRO)
def star_rules(spark, sf):
    rules = [r for r in rules_for("astro") if r.table == "astro.nearby_stars"]
    return rule_counts({"astro.nearby_stars": stars(spark, sf)}, rules).select("rule", "total", "flagged")


@query("error_bar_rules", "SELECT 'negative_error' AS rule, count(*) AS total, count(*) FILTER (WHERE l_quantity < 3 OR l_tax < 0.01 OR l_discount < 0.01) AS flagged FROM lineitem")
def error_bar_rules(spark, sf):
    bars = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), (F.col("l_quantity") - 3).alias("radial_velocity_error"),
        (F.col("l_tax") - 0.01).alias("pmra_error"), (F.col("l_discount") - 0.01).alias("pmdec_error"))
    rules = [r for r in ALL_RULES if r.table == "astro.star_errors"]
    return rule_counts({"astro.star_errors": bars}, rules).select("rule", "total", "flagged")


_PLANET_SQL = f"""
    SELECT 'no_host_star' AS rule, count(*) AS total, count(*) FILTER (WHERE hostname IS NULL) AS flagged FROM ({planets_sql()})
    UNION ALL SELECT 'non_positive_orbit', count(*), count(*) FILTER (WHERE pl_orbper <= 0) FROM ({planets_sql()})
    UNION ALL SELECT 'non_positive_size', count(*), count(*) FILTER (WHERE pl_rade <= 0 OR pl_bmasse <= 0) FROM ({planets_sql()})
    UNION ALL SELECT 'no_gaia_id', count(*), count(*) FILTER (WHERE gaia_dr3_id IS NULL) FROM ({planets_sql()})
    UNION ALL SELECT 'unreadable_gaia_id', count(*), count(*) FILTER (WHERE gaia_dr3_id IS NOT NULL AND regexp_extract(gaia_dr3_id, '([0-9]+)\\s*$', 1) = '') FROM ({planets_sql()})"""


@query("planet_rules", _PLANET_SQL)
def planet_rules(spark, sf):
    rules = [r for r in rules_for("astro") if r.table == "astro.exoplanets"]
    return rule_counts({"astro.exoplanets": planets(spark, sf)}, rules).select("rule", "total", "flagged")


@query("domain_rules", f"SELECT rule, flagged, false AS skipped FROM ({_ASTRO}) UNION ALL SELECT rule, flagged, false FROM ({_PLANET_SQL}) UNION ALL SELECT 'negative_error', NULL, true")
def domain_rules(spark, sf):
    """All rules of one domain; a table of that domain that is not loaded is skipped."""
    tables = {"astro.nearby_stars": stars(spark, sf), "astro.exoplanets": planets(spark, sf)}
    return rule_counts(tables, rules_for("astro")).select("rule", "flagged", "skipped")


