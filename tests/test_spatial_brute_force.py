"""Grid joins against all pairs on skies with poles, wraps, crowds, copies and exact edges."""

import math
import random

import pytest

from strata.operators import spatial


def rnd(seed):
    return random.Random(seed)


@pytest.mark.parametrize("kind", ["spread", "edges", "hot_cell"])
def test_band_neighbours(spark, kind):
    r = rnd(kind)
    if kind == "spread":
        points = [(i, r.gauss(0, 1), r.gauss(0, 6)) for i in range(800)]
    elif kind == "edges":
        points = [(i, r.randrange(30) * 0.125, r.randrange(30) * 0.5) for i in range(400)]
    else:
        points = [(i, 1.0 + r.random() * 1e-3, 1.0) if i % 3 else (i, r.random() * 6, r.random() * 20) for i in range(900)]
    w = (0.125, 1.0) if kind == "edges" else (0.15, 1.0)
    want = {}
    for i, x, y in points:
        n = sum(1 for j, a, b in points if j != i and abs(a - x) <= w[0] and abs(b - y) <= w[1])
        if n < 5:
            want[i] = n
    df = spark.createDataFrame(points, "id int, x double, y double")
    assert {q["id"]: q["neighbours"] for q in spatial.band_neighbours(df, "id", "x", "y", *w, 5).collect()} == want


def separation(p_ra, p_dec, ra, dec, pmra, pmdec, years):
    new_dec = dec + (pmdec or 0) * years / 3600000.0
    new_ra = ra + (pmra or 0) * years / 3600000.0 / math.cos(math.radians(dec))
    d_ra = (math.fmod(p_ra - new_ra + 540.0, 360.0) - 180.0) * math.cos(math.radians(p_dec))
    return 3600 * math.hypot(d_ra, p_dec - new_dec)


def test_sky_join(spark):
    r = rnd(2)
    stars, points = [], []
    for i in range(1500):
        ra, dec = [(r.random() * 360, math.degrees(math.asin(r.uniform(-1, 1)))), (r.choice([0.001, 359.999]) + r.gauss(0, .003), r.gauss(0, .01)),
                   (r.random() * 360, 90 - abs(r.gauss(0, .01))), (100.0, 20.0), (r.random() * 360, abs(r.gauss(0, .01)) - 90)][i % 5]
        moving = (10.0, 5.0) if i % 5 == 3 else (r.choice([None, r.gauss(0, 3000)]), r.gauss(0, 3000))
        stars.append((i, ra, dec, *moving))
    for j in range(120):
        s = r.choice(stars)
        points.append((j, (s[1] + r.gauss(0, .002) / max(1e-3, math.cos(math.radians(s[2])))) % 360, max(-90.0, min(90.0, s[2] + r.gauss(0, .002)))))
    want = {}
    for j, pr, pd in points:
        for s in stars:
            sep = min(separation(pr, pd, *s[1:], 0.0), separation(pr, pd, *s[1:], -16.0))
            if sep <= 10:
                want[j, s[0]] = sep
    p = spark.createDataFrame(points, "pid int, ra double, dec double")
    s = spark.createDataFrame(stars, "sid int, ra double, dec double, pmra double, pmdec double")
    got = spatial.sky_radius_join(p, s, 10.0).collect()
    assert len(got) == len(want) and all(abs(want[q["pid"], q["sid"]] - q["sep"]) < 1e-6 for q in got)
    best = {}
    for (j, i), sep in want.items():
        best.setdefault(j, []).append((sep, i))
    near = {q["pid"]: (q["sid"], q["candidates"]) for q in spatial.sky_nearest(p, s, 10.0).collect()}
    assert near == {j: (min(found)[1], len(found)) for j, found in best.items()}


@pytest.mark.parametrize("crowd", [256, 8])
def test_companions(spark, crowd):
    import numpy as np

    r, n, stars = rnd(5), 900, []
    for i in range(n):
        k = i % 5
        if k == 0 or not stars:
            stars.append((i, r.random() * 360, math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(20, 300), r.choice([None, .1, 1.0])))
        elif k == 1:
            b = r.choice(stars)
            stars.append((i, b[1] + r.gauss(0, .01), b[2] + r.gauss(0, .003), b[3] * (1 + r.gauss(0, .015)), .2))
        elif k == 2:
            stars.append((i, 50.0, -89.99999, 77.0, .1))
        elif k == 3:
            stars.append((i, 10 + r.gauss(0, 1e-4), 5 + r.gauss(0, 1e-4), r.uniform(60, 140), .05))
        else:
            stars.append((i, r.random() * .1, r.random() * .1, r.uniform(1, 30), r.uniform(.1, 12)))
    a = np.array([[math.radians(s[1]), math.radians(s[2]), s[3], s[4] or 0.0] for s in stars])
    u = np.stack([np.cos(a[:, 1]) * np.cos(a[:, 0]), np.cos(a[:, 1]) * np.sin(a[:, 0]), np.sin(a[:, 1])], 1)
    df = spark.createDataFrame(stars, "source_id int, ra double, dec double, parallax double, parallax_error double")
    got = {q["source_id"]: q["au"] for q in spatial.nearest_same_distance(df, 1000.0, crowd=crowd).collect()}
    assert len(got) == n
    for i in range(n):
        angle = np.degrees(2 * np.arcsin(np.minimum(1, np.sqrt(((u - u[i]) ** 2).sum(1)) / 2))) * 3600
        same = np.abs(a[:, 2] - a[i, 2]) <= 3 * np.hypot(a[:, 3], a[i, 3]) + .02 * np.maximum(a[:, 2], a[i, 2])
        au = np.where(same, angle * 1000 / a[i, 2], np.inf)
        au[i] = np.inf
        best = au.min() if au.min() < 1000 else math.inf
        assert got[i] == best or abs(got[i] - best) < 1e-6 * max(1, best), i


ODD = [None, math.nan, math.inf, -math.inf]


def test_bands_leave_out_what_is_no_number(spark):
    rows = [(i, 1.0 + i / 100, 2.0) for i in range(5)] + [(10 + k, x, y) for k, (x, y) in enumerate([(v, 2.0) for v in ODD] + [(1.0, v) for v in ODD])]
    got = spatial.band_neighbours(spark.createDataFrame(rows, "id int, x double, y double"), "id", "x", "y", 0.5, 0.5, 6)
    assert {r["id"]: r["neighbours"] for r in got.collect()} == {i: 4 for i in range(5)}


def test_sky_searches_leave_out_what_is_no_number(spark):
    points = spark.createDataFrame([(1, 10.0, 5.0), *[(2 + k, v, 5.0) for k, v in enumerate(ODD)], *[(7 + k, 10.0, v) for k, v in enumerate(ODD)]], "pid int, ra double, dec double")
    sky = [(1, 10.0, 5.0, 0.0, 0.0), (2, 10.0, 5.0, math.inf, math.nan), *[(3 + k, v, 5.0, 0.0, 0.0) for k, v in enumerate(ODD)], *[(8 + k, 10.0, v, 0.0, 0.0) for k, v in enumerate(ODD)]]
    stars = spark.createDataFrame(sky, "sid int, ra double, dec double, pmra double, pmdec double")
    pairs = {(r["pid"], r["sid"]) for r in spatial.sky_radius_join(points, stars, 10.0).collect()}
    assert (1, 1) in pairs and {p for p, _ in pairs} == {1} and {s for _, s in pairs} <= {1, 2}
    assert [(r["pid"], r["sid"]) for r in spatial.sky_nearest(points, stars, 10.0).collect()] == [(1, 1)]
    rows = [(1, 10.0, 5.0, 50.0, 0.1), (2, 10.0001, 5.0, 50.0, 0.1), *[(3 + k, 10.0, 5.0, v, 0.1) for k, v in enumerate(ODD)], *[(8 + k, v, 5.0, 50.0, 0.1) for k, v in enumerate(ODD)]]
    near = spatial.nearest_same_distance(spark.createDataFrame(rows, "source_id int, ra double, dec double, parallax double, parallax_error double"))
    assert {r["source_id"]: r["au"] < 1000 for r in near.collect()} == {1: True, 2: True}


def test_arguments(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    for bad in ((0, 1, 5), (1, -1, 5), (1, 1, 0)):
        with pytest.raises(ValueError):
            spatial.band_neighbours(df, "id", "x", "y", *bad)
    with pytest.raises(ValueError):
        spatial.sky_radius_join(df, df, 0)
    with pytest.raises(ValueError):
        spatial.nearest_same_distance(df, 0)


def test_tasks_of_a_sky_search_follow_its_pairs(spark):
    """All rows in one cell: four times the pairs get four times the tasks, no share holds much more than a task's pairs, none is lost."""
    from strata.operators import spatial

    reach = 10.0 / 3600 * (1 + 1e-6)
    found = []
    for n in (200, 400):
        points = spark.range(n).selectExpr("id AS pid", "10.0D AS p_ra", "20.0D + id * 1e-7 AS p_dec")
        sky = spark.range(n).selectExpr("id AS sid", "10.0D AS ra", "20.0D + id * 1e-7 AS dec", "0.0D AS pmra", "0.0D AS pmdec")
        left, right, tasks = spatial.spread(spatial._search_cells(points, reach), spatial._star_cells(sky, reach, (2016.0,)), "sid", per_task=4000)
        assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() == tasks
        met = left.join(right, ["zone", "cell", "share"])
        assert met.count() == n * n and met.select("pid", "sid").distinct().count() == n * n
        assert met.groupBy("zone", "cell", "share").count().agg({"count": "max"}).first()[0] <= 3 * 4000
        found.append(tasks)
    assert found == [10, 40]
    pairs = spatial.sky_radius_join(points.selectExpr("pid", "p_ra AS ra", "p_dec AS dec"), sky, 10.0, epochs=(2016.0,))
    assert pairs.count() == 400 * 400


def test_odd_values_take_no_task_of_a_sky_search(spark):
    """Positions that are none make neither pairs nor tasks, also where all the rest meets in one cell; no position at all is one empty task."""
    from strata.operators import spatial

    reach = 10.0 / 3600 * (1 + 1e-6)
    points = spark.range(300).selectExpr("id AS pid", "10.0D AS ra", "CASE id % 3 WHEN 0 THEN 20.0D WHEN 1 THEN 1e300D ELSE double('NaN') END AS dec")
    sky = spark.range(300).selectExpr("id AS sid", "10.0D AS ra", "20.0D AS dec", "0.0D AS pmra", "CASE WHEN id % 2 = 0 THEN -1e300D ELSE 0.0D END AS pmdec")
    usable = points.filter(spatial.on_sky("ra", "dec")).selectExpr("pid", "ra AS p_ra", "dec AS p_dec")
    for epochs, tasks in (((2016.0,), 30), ((2016.0, 2000.0), 45)):
        assert spatial.spread(spatial._search_cells(usable, reach), spatial._star_cells(sky, reach, epochs), "sid", per_task=1000)[2] == tasks
        assert spatial.sky_radius_join(points, sky, 10.0, epochs=epochs).count() == 100 * 300
    assert spatial.sky_radius_join(points.filter("pid % 3 > 0"), sky, 10.0).count() == 0
