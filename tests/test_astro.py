import math

import pytest
from pyspark.sql import functions as F

from strata.plans import astro
from strata.plans.registry import PLANETS
from tests.conftest import star_frame

PLANET_SCHEMA = "pl_name string, hostname string, gaia_dr3_id string"
POSITION_SCHEMA = "pl_name string, hostname string, ra double, dec double"


def planet(spark, *rows):
    return spark.createDataFrame(list(rows), PLANET_SCHEMA)


def placed(spark, *rows):
    return spark.createDataFrame([(p, "H", float(ra), float(dec)) for p, ra, dec in rows], POSITION_SCHEMA)


def test_speed_of_a_known_star(spark):
    stars = star_frame(spark, dict(source_id=1, parallax=546.976, pmra=-802.803, pmdec=10362.394, phot_g_mean_mag=8.2),
                       dict(source_id=2, parallax=100.0, pmra=3.0, pmdec=4.0), dict(source_id=3, parallax=-1.0, pmra=1.0, pmdec=1.0),
                       dict(source_id=4, parallax=5.0, pmra=None, pmdec=1.0))
    middle, rows = astro.fastest(stars, 5)
    rows = rows.collect()
    assert [r["source_id"] for r in rows] == [1, 2] and abs(rows[0]["km_s"] - 90.1) < 0.2
    m = middle.first()
    assert m["n"] == 2 and abs(m["median"] - (rows[0]["km_s"] + rows[1]["km_s"]) / 2) < 1e-9
    assert astro.fastest_report(stars, 1).first()["km_s"] == 90.1
    with pytest.raises(ValueError):
        astro.fastest(stars, 0)
    assert astro.fastest(star_frame(spark), 3)[0].first()["n"] == 0


def flying(source_id, vt, vr, parallax=100.0):
    """A star at 1000/parallax parsecs with these sideways and radial speeds."""
    return dict(source_id=source_id, parallax=parallax, pmra=vt * parallax / 4.74047, pmdec=0.0, radial_velocity=vr)


def test_closest_approach_closed_form(spark):
    stars = star_frame(spark, flying(1, 1.0, -10.0), flying(2, 1.0, 10.0), flying(3, 0.0, 0.0), flying(4, 5.0, -10.0), dict(source_id=5, parallax=9.0))
    r = astro.flybys(stars, max_myr=5.0).collect()
    assert [x["source_id"] for x in r] == [1, 4]
    assert math.isclose(r[0]["miss_pc"], 10 / math.sqrt(101), rel_tol=1e-12)
    assert math.isclose(r[0]["when_myr"], 100 / 101 * 0.977792221, rel_tol=1e-8)
    assert [x["source_id"] for x in astro.flybys(stars, past=True).collect()] == [2]
    assert astro.flybys(stars, max_myr=0.5).count() == 0
    counts = astro.flyby_counts(stars).first()
    assert (counts["total"], counts["usable"], counts["in_window"]) == (5, 4, 2)
    report = astro.flyby_report(stars).first()
    assert report["miss_pc"] == 0.995 and report["miss_au"] == round(10 / math.sqrt(101) * 206264.806)
    for bad in (dict(top=0), dict(max_myr=0)):
        with pytest.raises(ValueError):
            astro.flybys(stars, **bad)


def test_error_bars_show_where_they_exist(spark):
    stars = star_frame(spark, flying(1, 1.0, -10.0), flying(4, 5.0, -10.0))
    errors = spark.createDataFrame([(1, 0.25, 7)], "source_id bigint, radial_velocity_error double, rv_nb_transits bigint")
    got = {r["source_id"]: (r["rv_err_kms"], r["rv_transits"]) for r in astro.flybys(stars, errors).collect()}
    assert got == {1: (0.25, 7), 4: (None, None)}
    assert "rv_err_kms" in astro.flyby_report(stars, errors).columns and "rv_err_kms" in astro.approaches(stars, errors).columns


def lit(source_id, colour, mag):
    """A star ten parsecs away, where absolute and apparent magnitude agree."""
    return dict(source_id=source_id, parallax=100.0, bp_rp=colour, phot_g_mean_mag=mag)


def test_a_star_away_from_the_crowd_is_flagged(spark):
    stars = star_frame(spark, *[lit(i, 1.0 + i * 0.001, 5.0) for i in range(20)], lit(99, 3.0, 5.0), lit(98, None, 5.0), dict(source_id=97))
    rows = astro.misfits(stars).collect()
    assert [(r["source_id"], r["neighbours"]) for r in rows] == [(99, 0)] and rows[0]["abs_g"] == 5.0
    assert tuple(astro.misfit_counts(stars).first()) == (23, 21)


def test_window_edges_count_as_near(spark):
    crowd = [lit(i, 0.5, 5.0) for i in range(5)]
    for colour, mag, alone in ((0.625, 5.0, False), (0.5, 6.0, False), (0.375, 4.0, False), (0.6251, 5.0, True), (0.5, 6.0001, True)):
        flagged = {r["source_id"] for r in astro.misfits(star_frame(spark, *crowd, lit(9, colour, mag)), 0.125, 1.0).collect()}
        assert (9 in flagged) is alone, (colour, mag)
    with pytest.raises(ValueError):
        astro.misfits(star_frame(spark), colour_window=0)
    with pytest.raises(ValueError):
        astro.misfits(star_frame(spark), min_neighbours=0)


def test_id_texts(spark):
    cases = {"Gaia DR3 4472832130942575872": 4472832130942575872, "123": 123, "Gaia DR3 5  ": 5, "none": None, "Gaia DR3 5x": None,
             "Gaia DR3 99999999999999999999": None}
    rows = planet(spark, *[(t, "h", t) for t in cases])
    got = {r["pl_name"]: r["source_id"] for r in astro.planet_ids(rows).collect()}
    assert got == {k: v for k, v in cases.items() if v is not None}


def test_hosts_match_by_id_first_then_by_position(spark):
    stars = star_frame(spark, dict(source_id=7, ra=50.0, dec=10.0), dict(source_id=8, ra=80.0, dec=-5.0))
    known = planet(spark, ("by id", "A", "Gaia DR3 7"), ("by place", "B", None), ("unreadable", "C", "n/a"), ("nowhere", "D", None))
    where = placed(spark, ("by id", 80, -5), ("by place", 80.0, -5.0005), ("unreadable", 80, -5), ("nowhere", 200, 60))
    rows = {r["pl_name"]: (r["source_id"], r["method"], r["candidates"]) for r in astro.match_hosts(known, stars, where).collect()}
    assert rows == {"by id": (7, "gaia_id", 1), "by place": (8, "position", 1)}
    assert tuple(astro.match_summary(astro.match_hosts(known, stars, where), known).first()) == (4, 1, 1, 2, 2)
    assert [r["pl_name"] for r in astro.match_hosts(known, stars).collect()] == ["by id"]
    with pytest.raises(ValueError):
        astro.match_hosts(known, stars, where, radius_arcsec=0)


@pytest.mark.parametrize("star,where,sep", [
    # Sixteen years of motion: the position is from the year 2000.
    (dict(ra=165.8, dec=36.0, pmra=-580.0, pmdec=-4765.0), (165.8 + 16 * 580 / 3.6e6 / math.cos(math.radians(36.0)), 36.0 + 16 * 4765 / 3.6e6), 0.0),
    # Right ascension wraps at 360.
    (dict(ra=359.9999, dec=0.0), (0.0002, 0.0), 1.08),
    # Right ascension lines meet at the poles.
    (dict(ra=10.0, dec=80.0), (10.0 + 40 / 3600, 80.0), 40 * math.cos(math.radians(80.0))),
    (dict(ra=0.0, dec=89.9999), (180.0, 89.9999), None),
])
def test_positions_over_time_wrap_and_pole(spark, star, where, sep):
    stars = star_frame(spark, dict(source_id=1, **star))
    rows = astro.match_hosts(planet(spark, ("p", "H", None)), stars, placed(spark, ("p", *where))).collect()
    if sep is None:
        # Opposite sides of the pole: the flat formula sees half a circle shrunk by cos(dec).
        sep = 180 * 3600 * math.cos(math.radians(89.9999))
    assert (len(rows) == 1) is (sep <= 10)
    if rows:
        assert abs(rows[0]["sep_arcsec"] - sep) < 1e-3


def test_nearest_candidate_wins_and_all_are_counted(spark):
    stars = star_frame(spark, dict(source_id=1, ra=10.0, dec=6 / 3600), dict(source_id=2, ra=10.0, dec=2 / 3600), dict(source_id=3, ra=10.0, dec=2 / 3600),
                       dict(source_id=4, ra=10.0, dec=20 / 3600))
    r = astro.match_hosts(planet(spark, ("p", "H", None), ("q", "H", None)), stars, placed(spark, ("p", 10, 0), ("q", 10, 0))).collect()
    assert sorted((x["pl_name"], x["source_id"], x["candidates"]) for x in r) == [("p", 2, 3), ("q", 2, 3)]


def test_companions(spark):
    def pair(p1, e1, p2, e2, gap=10.0):
        stars = star_frame(spark, dict(source_id=1, ra=10.0, dec=0.0, parallax=p1, parallax_error=e1),
                           dict(source_id=2, ra=10.0, dec=gap / 3600, parallax=p2, parallax_error=e2))
        return {r["source_id"]: r["au"] for r in astro.nearest_companion(stars).collect()}

    same = pair(100.0, 0.1, 100.0, None)
    assert math.isclose(same[1], 100.0, rel_tol=1e-9) and math.isclose(same[2], 100.0, rel_tol=1e-9)
    assert all(map(math.isfinite, pair(100.0, 1.0, 104.0, 1.0).values()))
    assert not any(map(math.isfinite, pair(100.0, 0.1, 104.0, 0.1).values()))
    # Seen from the farther star the same angle is longer.
    assert {k: math.isfinite(v) for k, v in pair(100.0, 2.0, 96.0, 2.0, gap=98.0).items()} == {1: True, 2: False}
    copies = star_frame(spark, *[dict(source_id=i, ra=5.0, dec=5.0, parallax=50.0, parallax_error=0.1) for i in range(3)])
    assert {r["au"] for r in astro.nearest_companion(copies).collect()} == {0.0}
    assert astro.nearest_companion(star_frame(spark, dict(source_id=1))).count() == 0


def test_planet_schema_has_what_matching_needs():
    assert {"pl_name", "hostname", "gaia_dr3_id"} <= set(PLANETS.schema)


def test_derived_columns_survive_zero_and_negative_parallax(spark):
    stars = star_frame(spark, dict(source_id=1, parallax=0.0, pmra=1.0, pmdec=1.0, phot_g_mean_mag=5.0), dict(source_id=2, parallax=-2.0, phot_g_mean_mag=5.0))
    rows = astro.with_abs_mag(astro.with_speed(astro.with_distance(stars))).orderBy("source_id").collect()
    assert [(r["pc"], r["km_s"], r["abs_g"]) for r in rows] == [(None, None, None), (-500.0, None, None)]
    assert stars.select(F.col("parallax")).count() == 2
