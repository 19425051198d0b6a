"""Datasets the lake knows: where their raw files sit, how they are read, and which table they fill."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from strata.functions.names import check_name, require, split_table
from strata.functions.parsing import TYPES, check_types


@dataclass(frozen=True)
class Dataset:
    source: str
    name: str
    format: str  # csv or json
    schema: dict = field(hash=False)  # csv: column -> type; json: column -> (type, dotted path)
    key: tuple[str, ...]
    table: str
    part_by: str | None = None  # SQL over key columns; decides which stored part a row belongs to

    def __post_init__(self):
        require(self.format in ("csv", "json"), f"unknown format {self.format!r}")
        split_table(self.table)
        check_types(self.types().values())
        for column in self.schema:
            check_name(column)
        absent = sorted(set(self.key) - set(self.schema))
        require(bool(self.key) and not absent, f"key columns not in the schema: {absent or 'none given'}")

    def types(self) -> dict[str, str]:
        return {n: (t if self.format == "csv" else t[0]) for n, t in self.schema.items()}

    def spark_types(self) -> dict[str, T.DataType]:
        return {n: TYPES[t] for n, t in self.types().items()}


# Columns, JSON paths, keys and folder names of the known datasets.
GAP_EVENTS = Dataset(
    "gfw", "gap-events", "json",
    {
        "start": ("timestamp", "start"),
        "end": ("timestamp", "end"),
        "vessel_id": ("string", "vessel.id"),
        "vessel_name": ("string", "vessel.name"),
        "vessel_type": ("string", "vessel.type"),
        "vessel_flag": ("string", "vessel.flag"),
        "duration_hours": ("float", "gap.duration_hours"),
        "intentional_disabling": ("bool", "gap.intentional_disabling"),
    },
    ("vessel_id", "start"), "ocean.gap_events",
    # Fetch windows overlap by days, so a new fetch touches the latest months only.
    part_by="date_format(start, 'yyyy-MM')",
)
NEARBY_STARS = Dataset(
    "gaia", "nearby-stars", "csv",
    {
        "source_id": "int", "ra": "float", "dec": "float", "parallax": "float", "parallax_error": "float",
        "pmra": "float", "pmdec": "float", "phot_g_mean_mag": "float", "bp_rp": "float", "radial_velocity": "float",
    },
    ("source_id",), "astro.nearby_stars",
)
STAR_ERRORS = Dataset(
    "gaia", "star-errors", "csv",
    {
        "source_id": "int", "radial_velocity_error": "float", "rv_nb_transits": "int",
        "pmra_error": "float", "pmdec_error": "float",
    },
    ("source_id",), "astro.star_errors",
)
PLANETS = Dataset(
    "exoplanets", "planets", "csv",
    {
        "pl_name": "string", "hostname": "string", "gaia_dr3_id": "string", "sy_dist": "float", "sy_plx": "float",
        "sy_gaiamag": "float", "sy_pnum": "int", "disc_year": "int", "discoverymethod": "string",
        "pl_orbper": "float", "pl_bmasse": "float", "pl_rade": "float",
    },
    ("pl_name",), "astro.exoplanets",
)
HOST_POSITIONS = Dataset(
    "exoplanets", "host-positions", "csv",
    {"pl_name": "string", "hostname": "string", "ra": "float", "dec": "float"},
    ("pl_name",), "astro.exoplanet_positions",
)

DATASETS: dict[tuple[str, str], Dataset] = {
    (d.source, d.name): d for d in (GAP_EVENTS, NEARBY_STARS, STAR_ERRORS, PLANETS, HOST_POSITIONS)
}

# Shell edges in parsecs for walking the star tables slice by slice.
STAR_SHELLS_PC = (20.0, 22.0, 24.0, 26.0, 28.0, 30.0)
ERROR_SHELLS_PC = (1.0, 10.0, 15.0, 20.0, 22.0, 24.0, 26.0, 28.0, 30.0)


def registry_frame(spark: SparkSession, datasets=None) -> DataFrame:
    """The registry as a table, one row per dataset."""
    rows = [(d.source, d.name, d.format, d.table, list(d.key)) for d in (datasets or DATASETS).values()]
    return spark.createDataFrame(rows, "source string, dataset string, format string, `table` string, key array<string>")
