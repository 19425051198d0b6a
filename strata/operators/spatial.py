"""Neighbour searches as equality joins on grid cells, followed by the exact predicate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.names import require
from strata.functions.scalars import angular_sep, unit_vector
from strata.session import write_scratch

# Cells are a hair wider than needed, so rounding can never push a neighbour out of reach.
_ROUNDING = 1 + 1e-9
#: Beyond so many window widths neighbouring doubles are more than a window apart.
FAR = 2.0 ** 54
#: Candidate pairs that one task of a sky search compares.
PAIRS_PER_TASK = 1_000_000
_CELL = ["cx", "cy", "far_x", "far_y"]
#: Degrees beyond which a finite number is no position on the sky, also after millennia of motion.
_NO_DEC, _NO_RA = 1e6, 1e9


def finite(*columns: str) -> Column:
    """True where all columns hold plain numbers: not null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce((F.abs(F.col(c).cast("double")) < float("inf")) & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    return out


def on_sky(ra: str, dec: str) -> Column:
    """True for positions: plain numbers within what a sphere and the motion of its stars can give."""
    return finite(ra, dec) & (F.abs(F.col(ra)) <= _NO_RA) & (F.abs(F.col(dec)) <= _NO_DEC)


def _offsets(reach: int) -> Column:
    return F.sequence(F.lit(-reach), F.lit(reach))


def band_neighbours(df: DataFrame, id_column: str, x: str, y: str, wx: float, wy: float, below: int) -> DataFrame:
    """(id, neighbours) of every row with fewer than `below` other rows within wx and wy (edges count).

    Cells are a third of a window wide, so all rows of a 3x3 block are neighbours of the rows in its centre cell.
    The block totals alone clear every row of a crowded block; only the few rows of sparse blocks are compared
    one by one, with the rows of the outer ring of cells. Pairs stay linear in the rows, however crowded a cell is.
    A row whose x or y is null, NaN or infinite is near nothing, not even itself, and is left out. Where doubles lie farther apart
    than a window is wide, only equal values are near, so such a value is a cell of its own that has no neighbouring cells.
    """
    require(wx > 0 and wy > 0, "windows must be positive")
    require(below >= 1, "below must be 1 or more")
    rows = df.select(
        F.col(id_column).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
    ).filter(finite("x") & finite("y"))
    for axis, width in (("x", wx), ("y", wy)):
        far = F.abs(F.col(axis)) >= FAR * width
        rows = rows.withColumn(f"far_{axis}", F.when(far, F.col(axis)).otherwise(0.0)).withColumn(
            f"c{axis}", F.floor(F.when(far, 0.0).otherwise(F.col(axis)) / (width / 3 * _ROUNDING)))
    cells = rows.groupBy(*_CELL).agg(F.count("*").alias("n"))
    spread = _shifted(cells, 1).select(
        (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "far_x", "far_y", "n",
        ((F.col("dx") == 0) & (F.col("dy") == 0)).alias("own"))
    blocks = spread.groupBy(*_CELL).agg(F.sum("n").alias("block"), F.max("own").alias("filled"))
    sparse = blocks.filter(F.col("filled") & (F.col("block") <= below)).select(*_CELL, "block")
    # Used twice below, so it is computed once.
    probes = write_scratch(rows.join(sparse, _CELL), "band")
    ring = _shifted(probes, 3).filter((F.abs("dx") > 1) | (F.abs("dy") > 1)).select(
        "id", F.col("x").alias("px"), F.col("y").alias("py"),
        (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "far_x", "far_y")
    near = (F.abs(F.col("px") - F.col("x")) <= wx) & (F.abs(F.col("py") - F.col("y")) <= wy)
    # Counts per id leave the join, not pairs.
    outer = ring.join(rows.select(*_CELL, "x", "y"), _CELL).filter(near).groupBy("id").agg(F.count("*").alias("outer"))
    total = F.col("block") - 1 + F.coalesce("outer", F.lit(0))
    return probes.select("id", "block").join(outer, "id", "left").select(
        F.col("id").alias(id_column), total.alias("neighbours")).filter(F.col("neighbours") < below)


def _shifted(df: DataFrame, reach: int) -> DataFrame:
    """Every row once per cell offset (dx, dy) up to `reach`; far values stay where they are."""
    for axis in "xy":
        df = df.withColumn(f"d{axis}", F.explode(F.when(F.col(f"far_{axis}") == 0.0, _offsets(reach)).otherwise(F.array(F.lit(0)))))
    return df


def moved_to(ra, dec, pmra, pmdec, years: float) -> tuple[Column, Column]:
    """Position in degrees after `years` of proper motion (mas per year)."""
    zero = F.lit(0.0)
    new_dec = F.col(dec) + F.coalesce(F.col(pmdec), zero) * F.lit(years) / F.lit(3600000.0)
    new_ra = F.col(ra) + F.try_divide(F.coalesce(F.col(pmra), zero) * F.lit(years) / F.lit(3600000.0), F.cos(F.radians(F.col(dec))))
    return new_ra, new_dec


def small_angle_sep(p_ra: Column, p_dec: Column, s_ra: Column, s_dec: Column) -> Column:
    """Separation in arcseconds for nearby positions; right ascension wraps at 360 and shrinks with cos(dec)."""
    d_ra = (((p_ra - s_ra) + 540.0) % 360.0 - 180.0) * F.cos(F.radians(p_dec))
    d_dec = p_dec - s_dec
    return 3600.0 * F.sqrt(d_ra * d_ra + d_dec * d_dec)


def _ra_cells(zone: Column, reach: float) -> tuple[Column, Column]:
    """(cells, half width of a search in degrees) of a declination zone two reaches high.

    A cell is at least as wide as a whole search in that zone, so a search meets at most two cells.
    """
    outermost = F.greatest(F.abs(zone * (2 * reach) - reach), F.abs((zone + 1) * (2 * reach) + reach))
    shrink = F.when(outermost < 90.0, F.cos(F.radians(outermost))).otherwise(0.0)
    cells = F.greatest(F.floor(F.lit(180.0 / reach) * shrink), F.lit(1))
    return cells, F.when(cells > 1, F.lit(reach) / shrink).otherwise(180.0)


def _turn(ra: Column) -> Column:
    return (ra % 360.0 + 360.0) % 360.0


def _search_cells(points: DataFrame, reach: float) -> DataFrame:
    """Points once per (zone, cell) their search circle can touch: two zones and two cells at most each."""
    height = 2 * reach
    zones = F.sequence(F.floor((F.col("p_dec") - reach) / height), F.floor((F.col("p_dec") + reach) / height))
    zoned = points.withColumn("zone", F.explode(zones))
    n, half = _ra_cells(F.col("zone"), reach)
    turn = _turn(F.col("p_ra"))
    span = F.sequence(F.floor((turn - half) / 360.0 * n), F.floor((turn + half) / 360.0 * n))
    return zoned.withColumn("cell", F.explode(F.array_distinct(F.transform(span, lambda c: F.pmod(c, n)))))


def _star_cells(stars: DataFrame, reach: float, epochs) -> DataFrame:
    """Stars once per epoch (`k`) with the zone and cell they stand in then; ra0, dec0, ra1, ... hold all epochs."""
    for i, epoch in enumerate(epochs):
        ra, dec = moved_to("ra", "dec", "pmra", "pmdec", float(epoch) - float(epochs[0]))
        stars = stars.withColumns({f"ra{i}": ra, f"dec{i}": dec})
    places = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"ra{i}").alias("ra"), F.col(f"dec{i}").alias("dec")) for i in range(len(epochs))])
    s = stars.drop("ra", "dec", "pmra", "pmdec").withColumn("place", F.explode(places))
    s = s.filter(on_sky("place.ra", "place.dec"))  # a motion without bounds leaves no position
    s = s.withColumn("zone", F.floor(F.col("place.dec") / (2 * reach)))
    n, _ = _ra_cells(F.col("zone"), reach)
    cell = F.pmod(F.floor(_turn(F.col("place.ra")) / 360.0 * n), n)
    return s.withColumns({"cell": cell, "k": F.col("place.k")}).drop("place")


def spread(searches: DataFrame, stars: DataFrame, sid: str, per_task: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with a `share` of their cell, dealt over as many tasks as their pairs need, and the number of tasks.

    Pairs can grow with the square of the rows, so their number, counted per cell beforehand, sets the number of tasks. The stars of a cell
    with more pairs than a task should hold are dealt over several shares, each of which all searches of that cell meet.
    """
    per_task = per_task or PAIRS_PER_TASK
    at = ["zone", "cell"]
    met = searches.groupBy(*at).agg(F.count("*").alias("_a")).join(stars.groupBy(*at).agg(F.count("*").alias("_b")), at)
    cells = write_scratch(met.select(*at, (F.col("_a") * F.col("_b")).alias("pairs")), "cells").withColumn("shares", F.ceil(F.col("pairs") / per_task))
    tasks = max(1, -(-(cells.agg(F.sum("pairs")).first()[0] or 0) // per_task))
    cells = cells.select(*at, "shares")
    left = searches.join(cells, at).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    right = stars.join(cells, at).withColumn("share", F.pmod(F.xxhash64(sid), F.col("shares"))).drop("shares")
    return left.repartition(tasks, *at, "share"), right.repartition(tasks, *at, "share"), tasks


def _close_pairs(searches: DataFrame, stars: DataFrame, radius_arcsec: float, epochs, sid: str) -> DataFrame:
    """Pairs within the radius with `sep`. A pair is taken at the first epoch that is close enough, so none repeats."""
    left, right, _ = spread(searches, stars, sid)
    seps = [small_angle_sep(F.col("p_ra"), F.col("p_dec"), F.col(f"ra{i}"), F.col(f"dec{i}")) for i in range(len(epochs))]
    joined = left.join(right, ["zone", "cell", "share"]).withColumns({f"_sep{i}": sep for i, sep in enumerate(seps)})
    first_close = F.coalesce(*[F.when(F.col(f"_sep{i}") <= radius_arcsec, F.lit(i)) for i in range(len(epochs))])
    least = F.least(*[F.col(f"_sep{i}") for i in range(len(epochs))]) if len(epochs) > 1 else F.col("_sep0")
    return joined.filter(first_close == F.col("k")).withColumn("sep", least)


def sky_radius_join(points: DataFrame, stars: DataFrame, radius_arcsec: float, epochs=(2016.0, 2000.0),
                    pid: str = "pid", sid: str = "sid") -> DataFrame:
    """(pid, sid, sep): all pairs closer than the radius at any of the epochs; the smallest separation counts.

    `points` needs pid, ra, dec; `stars` needs sid, ra, dec, pmra, pmdec at the first epoch. Declination zones are
    cut into right-ascension cells, so a pair is found by an equality join on its cell; the number of tasks follows the number of pairs. Null, NaN, infinite and absurdly large
    positions match nothing.
    """
    require(radius_arcsec > 0, "the radius must be positive")
    reach = radius_arcsec / 3600.0 * (1 + 1e-6)
    searches = _search_cells(points.filter(on_sky("ra", "dec")).select(pid, F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec")), reach)
    placed = _star_cells(stars.filter(on_sky("ra", "dec")).select(sid, "ra", "dec", "pmra", "pmdec"), reach, epochs)
    return _close_pairs(searches, placed, radius_arcsec, epochs, sid).select(pid, sid, "sep")


def sky_nearest(points: DataFrame, stars: DataFrame, radius_arcsec: float, epochs=(2016.0, 2000.0),
                pid: str = "pid", sid: str = "sid") -> DataFrame:
    """(pid, sid, sep, candidates): the nearest star per point and how many lie within the radius.

    Points at one position are searched once. They are written out first, so Spark knows their size and decides by it how
    to join. Stars with the same position and motion are counted once before the join, and pairs are reduced map-side,
    so piles of copies stay cheap. Positions that are null, NaN, infinite or absurdly large match nothing.
    """
    require(radius_arcsec > 0, "the radius must be positive")
    reach = radius_arcsec / 3600.0 * (1 + 1e-6)
    spots = write_scratch(points.filter(on_sky("ra", "dec")).select(F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec")).distinct(), "spots")
    searches = _search_cells(spots, reach)
    placed = _star_cells(stars.filter(on_sky("ra", "dec")).select(sid, "ra", "dec", "pmra", "pmdec"), reach, epochs)
    at = [f"{c}{i}" for i in range(len(epochs)) for c in ("ra", "dec")]
    stacks = placed.groupBy("zone", "cell", "k", *at).agg(F.min(sid).alias(sid), F.count("*").alias("_copies"))
    pairs = _close_pairs(searches, stacks, radius_arcsec, epochs, sid)
    best = pairs.groupBy("p_ra", "p_dec").agg(F.min(F.struct("sep", F.col(sid))).alias("_best"), F.sum("_copies").alias("candidates"))
    found = best.select(F.col("p_ra").alias("ra"), F.col("p_dec").alias("dec"), f"_best.{sid}", "_best.sep", "candidates")
    return points.select(pid, "ra", "dec").join(found, ["ra", "dec"]).select(pid, sid, "sep", "candidates")


def nearest_same_distance(df: DataFrame, max_au: float = 1000.0, id_column: str = "source_id",
                          crowd: int = 256) -> DataFrame:
    """(id, au): projected distance to the nearest other row at the same distance, infinity if none below max_au.

    Two rows are at the same distance if their parallaxes agree within 3 * hypot(e1, e2) + 0.02 * max(p1, p2);
    the separation is the angle times the row's own distance. Rows whose position or parallax is null, NaN or
    infinite, or whose parallax is not positive, are left out.

    Exact copies are each other's companion at distance zero and leave the search. The others meet in 3-D cells
    of their parallax class. Where cells are crowded the search runs over growing radii and only rows still
    without a companion go on to the next one.
    """
    require(max_au > 0, "max_au must be positive")
    usable = df.filter((F.col("parallax") > 0) & finite("ra", "dec", "parallax"))
    rows = usable.select(
        F.col(id_column).alias("id"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"),
        F.col("parallax").cast("double").alias("p"), F.coalesce(F.col("parallax_error").cast("double"), F.lit(0.0)).alias("e"))
    place = ["ra", "dec", "p", "e"]
    stacks = rows.groupBy(*place).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    ux, uy, uz = unit_vector("ra", "dec")
    stacks = write_scratch(
        stacks.select("id", *place, "copies", ux.alias("ux"), uy.alias("uy"), uz.alias("uz"),
                      F.floor(F.log2("p")).cast("int").alias("class")), "companions")
    # One row per factor of two in parallax, so at most about two thousand however large the table is.
    classes = stacks.groupBy("class").agg(F.max("e").alias("e")).collect()
    if not classes:
        return rows.select(F.col("id").alias(id_column), F.lit(float("inf")).alias("au"))
    targets = F.array(*[F.struct(F.lit(float(2.0 ** c["class"])).alias("lo"), F.lit(float(2.0 ** (c["class"] + 1))).alias("hi"),
                                 F.lit(c["class"]).alias("class"), F.lit(float(c["e"])).alias("e")) for c in classes])

    def reachable(c: Column) -> Column:
        # The closest parallax inside the class, and the loosest tolerance any of its rows can have.
        gap = F.greatest(c["lo"] - F.col("p"), F.col("p") - c["hi"], F.lit(0.0))
        return gap <= (3 * F.hypot(c["e"], F.col("e")) + 0.02 * F.greatest(c["hi"], F.col("p"))) * _ROUNDING

    reach = F.transform(F.filter(targets, reachable), lambda c: c["class"])
    partners = stacks.withColumn("class", F.explode(reach))
    search = stacks.filter("copies = 1")
    best = stacks.filter("copies > 1").select(*place, F.lit(0.0).alias("au"))
    for radius in _radii(partners, max_au, crowd):
        found = _companions_within(search, partners, radius)
        if radius < max_au:
            found = write_scratch(found, "companions")
            search = write_scratch(search.join(found.select("id"), "id", "left_anti"), "companions")
        best = best.unionByName(found.select(*place, "au"))
    spread = rows.join(best, place, "left")
    return spread.select(F.col("id").alias(id_column), F.coalesce("au", F.lit(float("inf"))).alias("au"))


#: Unit vectors of double precision do not tell positions apart below this separation of a star at one parsec.
ROUNDING_AU = 1e-10

_AXES = ("ux", "uy", "uz")


def _reach(radius_au: float) -> Column:
    """The longest chord a search in this class can need; a class spans a factor of two in parallax."""
    arcsec = F.lit(radius_au / 1000.0) * F.pow(F.lit(2.0), F.col("class") + 1)
    return F.least(F.radians(arcsec / 3600.0) * _ROUNDING, F.lit(2.0))


def _with_cell(df: DataFrame, radius_au: float) -> DataFrame:
    """Cells are two reaches wide, so a search meets at most two per axis."""
    return df.withColumns({f"c{a}": F.floor(F.col(a) / (2 * _reach(radius_au))) for a in _AXES})


def _with_search_cells(df: DataFrame, radius_au: float) -> DataFrame:
    r = _reach(radius_au)
    for a in _AXES:
        df = df.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(a) - r) / (2 * r)), F.floor((F.col(a) + r) / (2 * r)))))
    return df


def _radii(partners: DataFrame, max_au: float, crowd: int) -> list[float]:
    """Search radii, smallest first: shrink by 8 until no cell holds more than `crowd` rows.

    Rows at one position have collapsed before, so cells thin out until they are smaller than the rounding of a position.
    """
    radii = [max_au]
    while radii[-1] > ROUNDING_AU:
        fullest = _with_cell(partners, radii[-1]).groupBy("class", "cux", "cuy", "cuz").count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= crowd:
            break
        radii.append(radii[-1] / 8)
    return radii[::-1]


def _companions_within(search: DataFrame, partners: DataFrame, radius_au: float) -> DataFrame:
    """(id, place, au) of the rows of `search` that have a companion within the radius."""
    a = _with_search_cells(search, radius_au)
    b = _with_cell(partners, radius_au).select(
        "class", "cux", "cuy", "cuz", F.col("id").alias("b_id"), F.col("p").alias("bp"), F.col("e").alias("be"),
        F.col("ux").alias("bx"), F.col("uy").alias("by"), F.col("uz").alias("bz"))
    p, e = F.col("p"), F.col("e")
    same = F.abs(p - F.col("bp")) <= 3 * F.hypot(e, F.col("be")) + 0.02 * F.greatest(p, F.col("bp"))
    angle = angular_sep((F.col("ux"), F.col("uy"), F.col("uz")), (F.col("bx"), F.col("by"), F.col("bz")))
    au = angle * 3600.0 * (1000.0 / p)
    met = a.join(b, ["class", "cux", "cuy", "cuz"]).filter((F.col("id") != F.col("b_id")) & same)
    pairs = met.select("id", "ra", "dec", "p", "e", au.alias("au")).filter(F.col("au") < radius_au)
    return pairs.groupBy("id", "ra", "dec", "p", "e").agg(F.min("au").alias("au"))
