"""Sky analytics on stars and planets made of the given rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strata.functions.scalars import AU_PER_PARSEC, KM_S_PER_ARCSEC_YR_PC, MYR_PER_PC_PER_KM_S
from strata.plans import astro, model
from strata.session import write_scratch
from strata.workload.base import planets, planets_sql, positions, positions_sql, query, r6, stars, stars_sql, t, union
from strata.workload.relational import sep_sql

_ORDERS = ("orders", "o_orderkey")
_SPEED = f"{KM_S_PER_ARCSEC_YR_PC}::DOUBLE * sqrt(pmra * pmra + pmdec * pmdec) / parallax"
_MOVING = "pmra IS NOT NULL AND pmdec IS NOT NULL AND parallax > 0"
_V2 = f"nullif(radial_velocity * radial_velocity + ({_SPEED}) * ({_SPEED}), 0)"
_WHEN = f"-{MYR_PER_PC_PER_KM_S!r}::DOUBLE * (1000 / parallax) * radial_velocity / {_V2}"
_MISS = f"(1000 / parallax) * ({_SPEED}) / sqrt({_V2})"
_ABS = "phot_g_mean_mag + 5 * log10(parallax) - 10"


def _errors(spark, sf):
    """Error bars for two thirds of the stars made of orders."""
    return t(spark, sf, "orders").filter("o_orderkey % 3 <> 1").select(
        F.col("o_orderkey").alias("source_id"), (F.col("o_totalprice") / 1000).alias("radial_velocity_error"), (F.col("o_custkey") % 50).alias("rv_nb_transits"))


@query("derived_columns", f"""
    SELECT source_id, 1000 / parallax AS pc, {_SPEED} AS km_s, round({_ABS}, 6) AS abs_g
    FROM ({stars_sql(*_ORDERS)}) WHERE parallax > 0""")
def derived_columns(spark, sf):
    rows = astro.with_abs_mag(astro.with_speed(astro.with_distance(stars(spark, sf, *_ORDERS).filter("parallax > 0"))))
    return rows.select("source_id", "pc", "km_s", r6("abs_g").alias("abs_g"))


@query("fastest_movers", f"""
    SELECT source_id, 1000 / parallax AS pc, {_SPEED} AS km_s, sqrt(pmra * pmra + pmdec * pmdec) AS pm_mas_yr, phot_g_mean_mag AS g_mag
    FROM ({stars_sql(*_ORDERS)}) WHERE {_MOVING} ORDER BY {_SPEED} DESC, source_id LIMIT 30""")
def fastest_movers(spark, sf):
    _, rows = astro.fastest(stars(spark, sf, *_ORDERS), 30)
    return rows.select("source_id", "pc", "km_s", "pm_mas_yr", "g_mag")


@query("median_speed", f"SELECT count(*) AS n, median({_SPEED}) AS median FROM ({stars_sql(*_ORDERS)}) WHERE {_MOVING}")
def median_speed(spark, sf):
    middle, _ = astro.fastest(stars(spark, sf, *_ORDERS))
    return middle


@query("flybys", f"""
    SELECT a.source_id, when_myr, miss_pc, miss_pc * {AU_PER_PARSEC}::DOUBLE AS miss_au,
           o_totalprice / 1000 AS rv_err_kms, o_custkey % 50 AS rv_transits
    FROM (SELECT source_id, {_WHEN} AS when_myr, {_MISS} AS miss_pc FROM ({stars_sql(*_ORDERS)}) WHERE radial_velocity IS NOT NULL AND {_MOVING}) a
    LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 <> 1) e ON o_orderkey = source_id
    WHERE when_myr > 0 AND when_myr <= 5 ORDER BY a.miss_pc, a.source_id LIMIT 40""")
def flybys(spark, sf):
    rows = astro.flybys(stars(spark, sf, *_ORDERS), _errors(spark, sf), 40)
    return rows.select("source_id", "when_myr", "miss_pc", "miss_au", "rv_err_kms", "rv_transits")


@query("flybys_past", f"""
    SELECT source_id, when_myr, miss_pc FROM
      (SELECT source_id, {_WHEN} AS when_myr, {_MISS} AS miss_pc FROM ({stars_sql(*_ORDERS)}) WHERE radial_velocity IS NOT NULL AND {_MOVING})
    WHERE when_myr < 0 AND when_myr >= -0.5 ORDER BY miss_pc, source_id LIMIT 40""")
def flybys_past(spark, sf):
    rows = astro.flybys(stars(spark, sf, *_ORDERS), None, 40, 0.5, past=True)
    return rows.select("source_id", "when_myr", "miss_pc")


@query("flyby_counts", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE radial_velocity IS NOT NULL AND {_MOVING}) AS usable,
           count(*) FILTER (WHERE radial_velocity IS NOT NULL AND {_MOVING} AND {_WHEN} > 0 AND {_WHEN} <= 0.5) AS in_window FROM ({stars_sql(*_ORDERS)})""")
def flyby_counts(spark, sf):
    return astro.flyby_counts(stars(spark, sf, *_ORDERS), 0.5)


@query("density_misfits", f"""
    WITH s AS (SELECT source_id, parallax, phot_g_mean_mag AS g, bp_rp, {_ABS} AS abs_g FROM ({stars_sql()})
               WHERE bp_rp IS NOT NULL AND phot_g_mean_mag IS NOT NULL AND parallax > 0)
    SELECT a.source_id, 1000 / a.parallax AS pc, a.g AS g_mag, a.bp_rp, round(a.abs_g, 6) AS abs_g, count(*) - 1 AS neighbours
    FROM s a JOIN s b ON abs(a.bp_rp - b.bp_rp) <= 0.15 AND abs(a.abs_g - b.abs_g) <= 1.0 GROUP BY ALL HAVING count(*) - 1 < 12""")
def density_misfits(spark, sf):
    rows = astro.misfits(stars(spark, sf), min_neighbours=12)
    return rows.select("source_id", "pc", "g_mag", "bp_rp", r6("abs_g").alias("abs_g"), "neighbours")


@query("misfit_counts", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE bp_rp IS NOT NULL AND phot_g_mean_mag IS NOT NULL AND parallax > 0) AS judged FROM ({stars_sql(*_ORDERS)})""")
def misfit_counts(spark, sf):
    return astro.misfit_counts(stars(spark, sf, *_ORDERS))


# Named stars by the digits at the end of the id; unnamed ones by the least separation over the epochs, picked with arg_min.
_MATCHES = f"""
    WITH planet AS ({planets_sql()}), spot AS ({positions_sql()}), star AS ({stars_sql()}),
    numbered AS (SELECT pl_name, hostname, TRY_CAST(regexp_extract(gaia_dr3_id, '[0-9]+\\s*$') AS BIGINT) AS wanted FROM planet WHERE gaia_dr3_id IS NOT NULL),
    apart AS (SELECT spot.pl_name, star.source_id, min({sep_sql()}) AS d FROM spot, star, (VALUES (2016.0), (2000.0)) AS epoch(year) GROUP BY ALL HAVING d <= 10),
    closest AS (SELECT pl_name, arg_min(source_id, struct_pack(d := d, i := source_id)) AS source_id, min(d) AS d, count(*) AS near FROM apart GROUP BY 1),
    m AS (SELECT pl_name, hostname, source_id, 'gaia_id' AS method, NULL::DOUBLE AS sep_arcsec, 1::BIGINT AS candidates
          FROM numbered SEMI JOIN star ON star.source_id = wanted, LATERAL (SELECT wanted AS source_id)
          UNION ALL BY NAME
          SELECT pl_name, hostname, source_id, 'position' AS method, d AS sep_arcsec, near AS candidates FROM planet JOIN closest USING (pl_name) WHERE gaia_dr3_id IS NULL)"""


@query("cross_match", _MATCHES + " SELECT pl_name, hostname, source_id, method, round(sep_arcsec, 5) AS sep_arcsec, candidates FROM m")
def cross_match(spark, sf):
    rows = astro.match_hosts(planets(spark, sf), stars(spark, sf), positions(spark, sf))
    return rows.withColumn("sep_arcsec", F.round("sep_arcsec", 5))


@query("cross_match_by_id_only", _MATCHES + " SELECT pl_name, source_id, candidates FROM m WHERE method = 'gaia_id'")
def cross_match_by_id_only(spark, sf):
    return astro.match_hosts(planets(spark, sf), stars(spark, sf)).select("pl_name", "source_id", "candidates")


@query("match_summary", _MATCHES + """
    SELECT (SELECT count(*) FROM planet) AS planets, count(*) FILTER (WHERE method = 'gaia_id') AS by_id, count(*) FILTER (WHERE method = 'position') AS by_position,
           (SELECT count(*) FROM planet) - count(*) AS unmatched, count(DISTINCT source_id) AS stars FROM m""")
def match_summary(spark, sf):
    known = planets(spark, sf)
    return astro.match_summary(astro.match_hosts(known, stars(spark, sf), positions(spark, sf)), known)


_COMPANION = """
    u AS (SELECT source_id, parallax AS p, coalesce(parallax_error, 0) AS e, cos(radians("dec")) * cos(radians(ra)) AS x,
                 cos(radians("dec")) * sin(radians(ra)) AS y, sin(radians("dec")) AS z FROM s WHERE parallax > 0),
    c AS (SELECT a.source_id, min(degrees(2 * asin(least(1.0, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 2))) * 3600 * 1000 / a.p) AS au
          FROM u a JOIN u b ON a.source_id <> b.source_id AND abs(a.p - b.p) <= 3 * sqrt(a.e * a.e + b.e * b.e) + 0.02 * greatest(a.p, b.p) GROUP BY 1)"""


@query("nearest_companion", f"""
    WITH s AS ({stars_sql()}), {_COMPANION}
    SELECT u.source_id, CASE WHEN au < 1000 THEN round(au, 3) END AS au FROM u LEFT JOIN c USING (source_id)""")
def nearest_companion(spark, sf):
    rows = astro.nearest_companion(stars(spark, sf))
    return rows.select("source_id", F.when(F.col("au") < 1000, F.round("au", 3)).alias("au"))


@query("gap_features", f"""
    WITH s AS ({stars_sql()}), {_COMPANION},
    usable AS (SELECT * FROM s WHERE phot_g_mean_mag IS NOT NULL AND parallax > 0)
    SELECT usable.source_id, round(log10(1000 / parallax), 6) AS log10_distance_pc, phot_g_mean_mag AS g_mag,
           coalesce(bp_rp, (SELECT median(bp_rp) FROM usable)) AS bp_rp, round({_ABS}, 6) AS abs_g,
           CASE WHEN bp_rp IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS no_colour,
           CASE WHEN radial_velocity IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_rv,
           CASE WHEN au < 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_companion
    FROM usable LEFT JOIN c USING (source_id)""")
def gap_features(spark, sf):
    rows = model.gap_features(stars(spark, sf))
    return rows.select("source_id", r6("log10_distance_pc").alias("log10_distance_pc"), "g_mag", "bp_rp", r6("abs_g").alias("abs_g"),
                       "no_colour", "has_rv", "has_companion")


@query("fold_balance", """
    SELECT quality, count(*) // 5 AS smallest, CAST(ceil(count(*) / 5.0) AS BIGINT) AS largest, CAST(5 AS BIGINT) AS folds, count(*) AS n
    FROM labels GROUP BY 1""")
def fold_balance(spark, sf):
    folded = model.assign_folds(t(spark, sf, "labels"), "doc_id", "quality")
    sizes = folded.groupBy("quality", "fold").agg(F.count("*").alias("n"))
    return sizes.groupBy("quality").agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count("*").alias("folds"), F.sum("n").alias("n"))


def _documents(spark, sf):
    """Numeric traits of the labelled documents, taken from their whole texts."""
    text = F.col("text")
    docs = t(spark, sf, "documents").select(
        "doc_id", F.log1p(F.length(text)).alias("log_length"), (F.regexp_count(text, F.lit("\n")) / (F.length(text) + 1)).alias("line_rate"),
        (F.regexp_count(text, F.lit("[0-9]")) / (F.length(text) + 1)).alias("digit_rate"), (F.col("lang") == "en").cast("double").alias("english"))
    return docs.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("oof_scores")
def oof_scores(spark, sf):
    rows, _ = model.oof_scores(_documents(spark, sf), ["log_length", "line_rate", "digit_rate", "english"], "quality", "doc_id")
    return rows.select("doc_id", "quality", "fold", F.round("score", 6).alias("score"))


def _gap_model(spark, sf):
    return model.planet_gaps(stars(spark, sf), planets(spark, sf), positions(spark, sf))


@query("gap_model_metrics")
def gap_model_metrics(spark, sf):
    return _gap_model(spark, sf).metrics


@query("gap_candidates")
def gap_candidates(spark, sf):
    return _gap_model(spark, sf).candidates


@query("gap_model_weights")
def gap_model_weights(spark, sf):
    return _gap_model(spark, sf).weights


# A one-feature model has a 2x2 Newton step, which a recursive query can take: 30 rounds from zero, for each fold's training set.
@query("oof_scores_one_feature", """
    WITH RECURSIVE d AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS fold, quality AS y, ln(1 + length(text)) AS x FROM documents JOIN labels USING (doc_id)),
    s AS (SELECT m, avg(x) AS mu, stddev_pop(x) AS sd FROM d, range(5) AS r(m) WHERE fold <> m GROUP BY m),
    seen AS (SELECT m, y, (x - mu) / sd AS z FROM d JOIN s ON fold <> m),
    fit(i, m, a, b) AS (
      SELECT 0, m, 0::DOUBLE, 0::DOUBLE FROM s
      UNION ALL
      SELECT i + 1, m, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
      FROM (SELECT i, m, a, b, sum(y - p) AS ga, sum((y - p) * z) - b AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * z) AS hab, sum(p * (1 - p) * z * z) + 1 AS hbb
            FROM (SELECT i, m, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM fit JOIN seen USING (m) WHERE i < 30) GROUP BY i, m, a, b))
    SELECT doc_id, y AS quality, fold, round(1 / (1 + exp(-(a + b * (x - mu) / sd))), 6) AS score
    FROM d JOIN s ON s.m = fold JOIN fit ON fit.m = fold WHERE i = 30""")
def oof_scores_one_feature(spark, sf):
    rows, _ = model.oof_scores(_documents(spark, sf), ["log_length"], "quality", "doc_id", fold=F.col("doc_id") % 5)
    return rows.select("doc_id", "quality", "fold", F.round("score", 6).alias("score"))


@query("fold_gradients", """
    WITH d AS (SELECT doc_id % 5 AS fold, quality FROM documents JOIN labels USING (doc_id))
    SELECT CAST(m AS INTEGER) AS model, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives, 0::DOUBLE AS gradient FROM d, range(5) AS r(m) WHERE fold <> m GROUP BY m""")
def fold_gradients(spark, sf):
    """Training rows, positives and the largest component of the penalised gradient of every fold model, which is zero at the optimum."""
    features = ["log_length", "line_rate", "digit_rate", "english"]
    rows = write_scratch(_documents(spark, sf).withColumn("fold", (F.col("doc_id") % 5).cast("int")), "folds")
    fits, _ = model.fold_fits(rows, features, "quality")
    out = []
    for m, fit in enumerate(fits):
        miss = F.col("quality") - fit.score(features)
        z = [(F.col(f) - F.lit(a)) / F.lit(s) for f, a, s in zip(features, fit.mean, fit.scale)]
        slopes = [F.abs(F.sum(miss)), *[F.abs(F.sum(miss * x) - F.lit(w)) for x, w in zip(z, fit.weight)]]
        out.append(rows.filter(F.col("fold") != m).agg(
            F.lit(m).alias("model"), F.count("*").alias("n"), F.sum("quality").cast("bigint").alias("positives"), F.round(F.greatest(*slopes), 4).alias("gradient")))
    return union(*out)


# The same recursion over stars, with brightness as the only feature; model 5 is trained on all of them.
_ONE_FEATURE = _MATCHES.replace("WITH", "WITH RECURSIVE", 1) + f""",
    d AS (SELECT source_id, CAST(source_id IN (SELECT source_id FROM m) AS INTEGER) AS y, phot_g_mean_mag AS x, source_id % 5 AS fold
          FROM ({stars_sql()}) WHERE phot_g_mean_mag IS NOT NULL AND parallax > 0),
    s AS (SELECT k, avg(x) AS mu, stddev_pop(x) AS sd FROM d, range(6) AS r(k) WHERE fold <> k GROUP BY k),
    seen AS (SELECT k, y, (x - mu) / sd AS z FROM d JOIN s ON fold <> k),
    fit(i, k, a, b) AS (
      SELECT 0, k, 0::DOUBLE, 0::DOUBLE FROM s
      UNION ALL
      SELECT i + 1, k, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
      FROM (SELECT i, k, a, b, sum(y - p) AS ga, sum((y - p) * z) - b AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * z) AS hab, sum(p * (1 - p) * z * z) + 1 AS hbb
            FROM (SELECT i, k, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM fit JOIN seen USING (k) WHERE i < 30) GROUP BY i, k, a, b))"""


def _one_feature_model(spark, sf):
    return model.planet_gaps(stars(spark, sf), planets(spark, sf), positions(spark, sf), 100, ["g_mag"], F.col("source_id") % 5)


@query("gap_candidates_one_feature", _ONE_FEATURE + """
    SELECT source_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, source_id) AS place
    FROM (SELECT source_id, 1 / (1 + exp(-(a + b * (x - mu) / sd))) AS score FROM d JOIN s ON s.k = fold JOIN fit ON fit.k = fold WHERE i = 30 AND y = 0)
    ORDER BY place LIMIT 100""")
def gap_candidates_one_feature(spark, sf):
    """The hundred best candidates and their places."""
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "source_id")).cast("bigint")  # over a hundred rows
    return _one_feature_model(spark, sf).candidates.select("source_id", F.round("score", 6).alias("score"), place.alias("place"))


@query("gap_weights_one_feature", _ONE_FEATURE + " SELECT 'g_mag' AS feature, round(b, 6) AS weight FROM fit WHERE i = 30 AND k = 5")
def gap_weights_one_feature(spark, sf):
    return _one_feature_model(spark, sf).weights.select("feature", F.round("weight", 6).alias("weight"))


@query("gap_model_counts", _MATCHES + f""", judged AS (
      SELECT s.source_id, s.source_id IN (SELECT source_id FROM m) AS host FROM ({stars_sql()}) AS s WHERE phot_g_mean_mag IS NOT NULL AND parallax > 0)
    SELECT count(*) AS n_stars, count(*) FILTER (WHERE host) AS n_hosts, (SELECT count(*) FROM ({stars_sql()})) - count(*) AS skipped, 5 AS folds,
           round(avg(CAST(host AS DOUBLE)), 9) AS base_rate FROM judged""")
def gap_model_counts(spark, sf):
    found = model.planet_gaps(stars(spark, sf), planets(spark, sf), positions(spark, sf)).metrics
    return found.select("n_stars", "n_hosts", "skipped", "folds", F.round("base_rate", 9).alias("base_rate"))
