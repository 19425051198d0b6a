"""Domain scalar functions, all built from built-in column functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions.names import require

# Unit conversions.
KM_S_PER_ARCSEC_YR_PC = 4.74047
PARSEC_KM = 3.0856775814913673e13
MYR_SECONDS = 3.15576e13
AU_PER_PARSEC = 206264.806
MYR_PER_PC_PER_KM_S = PARSEC_KM / MYR_SECONDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance_pc(parallax: Column | str) -> Column:
    """Parsecs from a parallax in milliarcseconds; NULL for a zero parallax."""
    return F.try_divide(F.lit(1000.0), _col(parallax))


def total_motion(pmra: Column | str, pmdec: Column | str) -> Column:
    a, b = _col(pmra), _col(pmdec)
    return F.sqrt(a * a + b * b)


def tangential_speed(pmra, pmdec, parallax) -> Column:
    """Sideways speed in km/s."""
    return F.try_divide(F.lit(KM_S_PER_ARCSEC_YR_PC) * total_motion(pmra, pmdec), _col(parallax))


def absolute_magnitude(apparent, parallax) -> Column:
    """Brightness at ten parsecs; defined for positive parallaxes only."""
    p = _col(parallax)
    return F.when(p > 0, _col(apparent) + 5 * F.log10(p) - 10)


def trailing_id(text: Column | str) -> Column:
    """The number at the end of a text, e.g. a catalogue name followed by an id; NULL if there is none."""
    digits = F.regexp_extract(_col(text), r"([0-9]+)\s*$", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def unit_vector(ra_deg, dec_deg) -> tuple[Column, Column, Column]:
    ra, dec = F.radians(_col(ra_deg)), F.radians(_col(dec_deg))
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def angular_sep(u: tuple[Column, Column, Column], v: tuple[Column, Column, Column]) -> Column:
    """Angle between two unit vectors in degrees, from the chord (exact for tiny angles, unlike arccos)."""
    dx, dy, dz = (a - b for a, b in zip(u, v))
    chord = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / 2)))


def content_hash(content: Column | str) -> Column:
    return F.sha2(_col(content), 256)


# Fixed format: <start>_<end>_<region>.json
_WINDOW_NAME = r"^(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})_(.+)\.json$"


def parse_window_name(filename: Column | str) -> tuple[Column, Column, Column]:
    """(start date, end date, region) of a window file; all NULL if the name has another shape."""
    name = _col(filename)
    is_window = name.rlike(_WINDOW_NAME) & ~name.endswith(".meta.json")

    def part(i: int) -> Column:
        return F.when(is_window, F.regexp_extract(name, _WINDOW_NAME, i))

    return part(1).try_cast("date"), part(2).try_cast("date"), part(3)


def next_window(mark, today: date, overlap_days: int, max_days: int, since: date | None = None):
    """(start, end, catching_up) of the next fetch after `mark`; all NULL once covered through today."""
    require(max_days >= 1 and overlap_days >= 0, "max_days must be 1 or more and overlap_days 0 or more")
    now, covered = F.lit(today), _col(mark)
    if since is None:
        start = F.when(covered < now, F.date_sub(covered, overlap_days))
    else:
        require(since < today, f"since {since} must be before today ({today})")
        start = F.lit(since)
    end = F.when(start.isNotNull(), F.least(now, F.date_add(start, max_days)))
    return start, end, end < now


def shell_edges(spark: SparkSession, near: float, far: float, step: float) -> DataFrame:
    """Cut near..far (parsecs) into shells: (ord, near_pc, far_pc, hi, lo) with hi/lo the parallax edges.

    Both edges come from the same rounded expression, so one shell's lo is exactly the next one's hi.
    """
    require(0 < near < far and step > 0, "need 0 < near < far and step > 0")
    stops = [near]
    while stops[-1] + step < far - 1e-9:
        stops.append(stops[-1] + step)
    return shells_between(spark, [*stops, far])


def shells_between(spark: SparkSession, stops: list[float]) -> DataFrame:
    """The same for explicit distances."""
    require(len(stops) >= 2 and all(a < b for a, b in zip(stops, stops[1:])) and stops[0] > 0,
            "distances must be positive and increasing")
    pairs = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(stops, stops[1:]))]
    return spark.createDataFrame(pairs, "ord int, near_pc double, far_pc double").select(
        "ord", "near_pc", "far_pc",
        F.round(1000.0 / F.col("near_pc"), 4).alias("hi"),
        F.round(1000.0 / F.col("far_pc"), 4).alias("lo"),
    )
