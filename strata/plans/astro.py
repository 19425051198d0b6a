"""Sky analytics over the curated tables. All take and return DataFrames and change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.names import require
from strata.functions.scalars import (
    AU_PER_PARSEC, MYR_PER_PC_PER_KM_S, absolute_magnitude, distance_pc, tangential_speed, total_motion, trailing_id,
)
from strata.operators.aggregates import count_where, median_of
from strata.operators.joins import attach_errors, existing_rows, join_on_name, join_on_text_id
from strata.operators.spatial import band_neighbours, nearest_same_distance, sky_nearest
from strata.operators.topk import top_k
from strata.session import write_scratch

# Default windows, limits and epochs.
COLOUR_WINDOW, MAG_WINDOW, MIN_NEIGHBOURS = 0.15, 1.0, 5
RADIUS_ARCSEC, STAR_EPOCH, CATALOGUE_EPOCH = 10.0, 2016.0, 2000.0
COMPANION_AU = 1000.0

HAS_MOTION = "pmra IS NOT NULL AND pmdec IS NOT NULL AND parallax > 0"
PLACEABLE = f"radial_velocity IS NOT NULL AND {HAS_MOTION}"
JUDGEABLE = "bp_rp IS NOT NULL AND phot_g_mean_mag IS NOT NULL AND parallax > 0"


def with_distance(df: DataFrame, name: str = "pc") -> DataFrame:
    return df.withColumn(name, distance_pc("parallax"))


def with_speed(df: DataFrame, name: str = "km_s") -> DataFrame:
    return df.withColumn(name, tangential_speed("pmra", "pmdec", "parallax"))


def with_abs_mag(df: DataFrame, name: str = "abs_g") -> DataFrame:
    return df.withColumn(name, absolute_magnitude("phot_g_mean_mag", "parallax"))


def speeds(stars: DataFrame) -> DataFrame:
    """source_id, pc, km_s, pm_mas_yr, g_mag of every star with a measured motion."""
    moving = with_speed(with_distance(stars.filter(HAS_MOTION)))
    return moving.select("source_id", "pc", "km_s", total_motion("pmra", "pmdec").alias("pm_mas_yr"),
                         F.col("phot_g_mean_mag").alias("g_mag"))


def fastest(stars: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """((n, median) of the speeds, the `top` fastest stars)."""
    require(top >= 1, "top must be 1 or more")
    measured = speeds(stars)
    return median_of(measured, "km_s"), top_k(measured, "km_s", top, desc=True, tie="source_id")


def fastest_report(stars: DataFrame, top: int = 15) -> DataFrame:
    """The fastest stars as shown to a reader: ordered and rounded."""
    _, rows = fastest(stars, top)
    return rows.select("source_id", F.round("pc", 1).alias("pc"), F.round("km_s", 1).alias("km_s"),
                       F.round("pm_mas_yr").alias("pm_mas_yr"), F.round("g_mag", 1).alias("g_mag"))


def approaches(stars: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Closest approach of every placeable star moving in a straight line: when_myr, miss_pc and the inputs."""
    d, vt, vr = distance_pc("parallax"), tangential_speed("pmra", "pmdec", "parallax"), F.col("radial_velocity")
    v2 = F.nullif(vr * vr + vt * vt, F.lit(0.0))
    out = stars.filter(PLACEABLE).select(
        "source_id",
        (-F.lit(MYR_PER_PC_PER_KM_S) * d * vr / v2).alias("when_myr"),
        (d * vt / F.sqrt(v2)).alias("miss_pc"),
        d.alias("pc_now"), vr.alias("v_toward_kms"), vt.alias("v_sideways_kms"), F.col("phot_g_mean_mag").alias("g_mag"),
    )
    if errors is None:
        return out
    return attach_errors(out, errors.select(
        "source_id", F.col("radial_velocity_error").alias("rv_err_kms"), F.col("rv_nb_transits").alias("rv_transits")))


def time_window(max_myr: float, past: bool = False) -> Column:
    when = F.col("when_myr")
    return (when < 0) & (when >= -max_myr) if past else (when > 0) & (when <= max_myr)


def flybys(stars: DataFrame, errors: DataFrame | None = None, top: int = 15, max_myr: float = 5.0, past: bool = False) -> DataFrame:
    """The `top` closest misses inside the time window.

    Error bars are looked up for the final rows only: those few ids are broadcast, so the error table is filtered where
    it is read and never shuffled.
    """
    require(top >= 1 and max_myr > 0, "top must be 1 or more and max_myr above 0")
    best = top_k(approaches(stars).filter(time_window(max_myr, past)), "miss_pc", top, tie="source_id")
    out = best.withColumn("miss_au", F.col("miss_pc") * AU_PER_PARSEC)
    if errors is None:
        return out
    out = write_scratch(out, "flybys")
    bars = errors.select("source_id", F.col("radial_velocity_error").alias("rv_err_kms"), F.col("rv_nb_transits").alias("rv_transits"))
    return attach_errors(out, existing_rows(bars, out, "source_id"))


def flyby_report(stars: DataFrame, errors: DataFrame | None = None, top: int = 15, max_myr: float = 5.0, past: bool = False) -> DataFrame:
    """The closest flybys as shown to a reader: rounded, closest miss first."""
    rows = flybys(stars, errors, top, max_myr, past).orderBy("miss_pc", "source_id")
    digits = {"when_myr": 3, "miss_pc": 3, "miss_au": 0, "pc_now": 1, "v_toward_kms": 1, "v_sideways_kms": 1, "g_mag": 1}
    shown = [F.round(c, n).cast("bigint" if c == "miss_au" else "double").alias(c) for c, n in digits.items()]
    extra = [] if errors is None else [F.round("rv_err_kms", 2).alias("rv_err_kms"), F.col("rv_transits")]
    return rows.select("source_id", *shown, *extra)


def flyby_counts(stars: DataFrame, max_myr: float = 5.0, past: bool = False) -> DataFrame:
    """(total, usable, in_window) in one pass."""
    require(max_myr > 0, "max_myr must be above 0")
    d, vt, vr = distance_pc("parallax"), tangential_speed("pmra", "pmdec", "parallax"), F.col("radial_velocity")
    when = -F.lit(MYR_PER_PC_PER_KM_S) * d * vr / F.nullif(vr * vr + vt * vt, F.lit(0.0))
    usable = F.expr(PLACEABLE)
    inside = (when < 0) & (when >= -max_myr) if past else (when > 0) & (when <= max_myr)
    return count_where(stars, {"usable": usable, "in_window": usable & inside})


def misfits(stars: DataFrame, colour_window: float = COLOUR_WINDOW, mag_window: float = MAG_WINDOW,
            min_neighbours: int = MIN_NEIGHBOURS, limit: int | None = None) -> DataFrame:
    """Stars with too few others nearby in colour and absolute magnitude, loneliest first.

    Columns: source_id, pc, g_mag, bp_rp, abs_g (not rounded) and neighbours.
    """
    require(min_neighbours >= 1, "min_neighbours must be 1 or more")
    judged = with_abs_mag(with_distance(stars.filter(JUDGEABLE))).select(
        "source_id", "pc", F.col("phot_g_mean_mag").alias("g_mag"), "bp_rp", "abs_g")
    lonely = band_neighbours(judged, "source_id", "bp_rp", "abs_g", colour_window, mag_window, min_neighbours)
    return top_k(judged.join(lonely, "source_id"), ["neighbours", "source_id"], limit)


def misfit_counts(stars: DataFrame) -> DataFrame:
    """(total, judged): stars without colour, brightness or distance are counted, never flagged."""
    return count_where(stars, {"judged": JUDGEABLE})


_MATCH = ("pl_name", "hostname", "source_id", "method", "sep_arcsec", "candidates")


def match_hosts(planets: DataFrame, stars: DataFrame, positions: DataFrame | None = None, radius_arcsec: float = RADIUS_ARCSEC) -> DataFrame:
    """One matched star per planet: by the number in the id text, else the nearest star by sky position.

    Only planets without any id text take the position route, so an unreadable id matches nothing.
    """
    require(radius_arcsec > 0, "radius_arcsec must be positive")
    by_id = join_on_text_id(planets.select("pl_name", "hostname", "gaia_dr3_id"), "gaia_dr3_id", stars.select("source_id"), "source_id").select(
        "pl_name", "hostname", "source_id", F.lit("gaia_id").alias("method"),
        F.lit(None).cast("double").alias("sep_arcsec"), F.lit(1).cast("bigint").alias("candidates"))
    if positions is None:
        return by_id
    unnamed = planets.filter(F.col("gaia_dr3_id").isNull()).select("pl_name", "hostname")
    placed = join_on_name(unnamed, positions.select("pl_name", "ra", "dec"), "pl_name")
    near = sky_nearest(placed, stars.select("source_id", "ra", "dec", "pmra", "pmdec"), radius_arcsec,
                       (STAR_EPOCH, CATALOGUE_EPOCH), pid="pl_name", sid="source_id")
    by_position = unnamed.join(near, "pl_name").select(
        "pl_name", "hostname", "source_id", F.lit("position").alias("method"), F.col("sep").alias("sep_arcsec"), "candidates")
    return by_id.unionByName(by_position)


def match_summary(matches: DataFrame, planets: DataFrame) -> DataFrame:
    """(planets, by_id, by_position, unmatched, stars) of a match run."""
    found = matches.agg(
        F.count_if(F.col("method") == "gaia_id").alias("by_id"), F.count_if(F.col("method") == "position").alias("by_position"),
        F.countDistinct("source_id").alias("stars"), F.count("*").alias("_matched"))
    total = planets.agg(F.count("*").alias("planets"))
    # Two one-row results side by side.
    joined = total.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k")
    return joined.select("planets", "by_id", "by_position", (F.col("planets") - F.col("_matched")).alias("unmatched"), "stars")


def nearest_companion(stars: DataFrame, max_au: float = COMPANION_AU) -> DataFrame:
    """(source_id, au) over all placeable stars, also those a model would leave out."""
    return nearest_same_distance(stars, max_au)


def planet_ids(planets: DataFrame) -> DataFrame:
    """(pl_name, source_id) where the id text is readable."""
    return planets.select("pl_name", trailing_id("gaia_dr3_id").alias("source_id")).filter(F.col("source_id").isNotNull())
