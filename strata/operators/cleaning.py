"""Raw text or JSON records -> typed rows, with every value that did not fit accounted for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from strata.functions.names import check_name, require
from strata.functions.parsing import blank_to_null, check_types, parse, usual
from strata.sources.files import last_parts

#: Bytes of a generated method above which the JVM interprets it instead of compiling it; Spark splits the work up if its own limit is set there.
_COMPILED_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"

BAD = "_bad"  # names of the columns whose value in this row did not fit its type; NULL for a clean row


def _typed(df: DataFrame, texts: dict[str, Column], types: dict[str, str], unfit: dict[str, Column]) -> DataFrame:
    """Project text columns to typed columns plus the list of unfit ones; all other columns pass through.

    Values in their usual spelling are read at once; only the others are stripped and taken apart.
    """
    helpers = [c for c in df.columns if c.startswith("_") or c == "path"]
    staged = df.select(*helpers, *[texts[n].alias(f"_raw_{n}") for n in types], *[c.alias(f"_unfit_{n}") for n, c in unfit.items()])
    quick = {n: c for n, t in types.items() if (c := usual(F.col(f"_raw_{n}"), t)) is not None}
    read = staged.withColumns({f"_quick_{n}": c for n, c in quick.items()})
    rest = {n: F.when(F.col(f"_quick_{n}").isNull(), F.col(f"_raw_{n}")) if n in quick else F.col(f"_raw_{n}") for n in types}
    stripped = read.withColumns({f"_text_{n}": blank_to_null(rest[n]) for n in types})
    parsed = stripped.withColumns({
        f"_value_{n}": F.coalesce(f"_quick_{n}", parse(F.col(f"_text_{n}"), t)) if n in quick else parse(F.col(f"_text_{n}"), t) for n, t in types.items()})

    def bad(name: str) -> Column:
        misfit = F.col(f"_text_{name}").isNotNull() & F.col(f"_value_{name}").isNull()
        return (misfit | F.col(f"_unfit_{name}")) if name in unfit else misfit

    # Column names hold no commas; joining and splitting them stays inside generated code, unlike an array filter.
    names = F.concat_ws(",", *[F.when(bad(n), F.lit(n)) for n in types])
    return parsed.select(
        *[F.col(f"_value_{n}").alias(n) for n in types], *helpers,
        F.split(F.nullif(names, F.lit("")), ",").alias(BAD),
    )


def clean(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Typed projection of all-text rows: trim, blank -> null, unfit -> null and listed in `_bad`.

    `schema` maps column -> type; columns outside it are dropped, except helper columns (`path`, `_...`).
    """
    check_types(schema.values())
    for name in schema:
        check_name(name)
    absent = sorted(set(schema) - set(df.columns))
    require(not absent, f"columns missing from the data: {absent}")
    return _typed(df, {n: F.col(n).cast("string") for n in schema}, schema, {})


def _json_path(path: str) -> str:
    keys = path.split(".")
    require(all(keys) and not any('"' in k for k in keys), f"not a dotted path: {path!r}")
    return "$" + "".join(f'["{k}"]' for k in keys)


def clean_json(df: DataFrame, schema: dict[str, tuple[str, str]], record: str = "record") -> DataFrame:
    """Flatten VARIANT records: `schema` maps column -> (type, dotted path).

    Absent or null -> null; a whole object or list at the path is bad; numbers keep the distinction between 20 and
    20.0, so a decimal number never fits an int column.
    """
    types = {name: t for name, (t, _) in schema.items()}
    check_types(types.values())
    for name in schema:
        check_name(name)
    picked = df.select(
        *[c for c in df.columns if c.startswith("_") or c == "path"],
        *[F.variant_get(F.col(record), _json_path(p), "variant").alias(f"_v_{n}") for n, (_, p) in schema.items()],
    )
    texts, unfit = {}, {}
    for name, type_name in types.items():
        kind = F.coalesce(F.schema_of_variant(F.col(f"_v_{name}")), F.lit("VOID"))
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        raw = F.try_variant_get(F.col(f"_v_{name}"), "$", "string")
        fractional = kind.startswith("DECIMAL") & ~raw.contains(".") & (F.length(raw) < 18)
        text = (
            F.when(nested | (kind == "VOID"), F.lit(None).cast("string"))
            .when(kind == "BOOLEAN", F.initcap(raw))
            .when(fractional, F.concat(raw, F.lit(".0")))
            .otherwise(raw)
        )
        texts[name], unfit[name] = text, nested
    out = _typed(picked, texts, types, unfit)
    return out.drop(*[f"_v_{n}" for n in schema])


def bad_value_counts(df: DataFrame, columns, by=()) -> DataFrame:
    """One row (per group): rows_in, rows_out and one count of bad values per column."""
    counts = [F.count_if(F.coalesce(F.array_contains(BAD, c), F.lit(False))).alias(f"bad_{c}") for c in columns]
    total = F.count("*")
    return df.groupBy(*by).agg(total.alias("rows_in"), total.alias("rows_out"), *counts)


@dataclass(frozen=True)
class CleanReport:
    """What a cleaning run read, what it wrote, and the values that did not fit."""

    rows_in: int
    rows_out: int
    bad_values: dict[str, int]

    @property
    def whole(self) -> bool:
        return self.rows_in == self.rows_out


def write_clean_reported(records: DataFrame, project: Callable[[DataFrame], DataFrame], columns, lake: str, source: str, dataset: str) -> CleanReport:
    """Clean and write in one job, counting records as the scan gives them and rows as the writer takes them.

    The two counts are taken at either end of `project`, so a row lost between them shows; no row is read a second time for the report.
    """
    seen, kept = Observation(), Observation()
    rows = project(records.observe(seen, F.count(F.lit(1)).alias("rows_in")))
    bad = [F.count_if(F.coalesce(F.array_contains(BAD, c), F.lit(False))).alias(f"bad_{c}") for c in columns]
    write_clean(rows.observe(kept, F.count(F.lit(1)).alias("rows_out"), *bad), lake, source, dataset)
    read, written = seen.get, kept.get  # empty where Spark knew beforehand that there are no rows
    return CleanReport(read.get("rows_in", 0), written.get("rows_out", 0), {c: n for c in columns if (n := written.get(f"bad_{c}", 0))})


def clean_report(df: DataFrame, columns, by=()) -> DataFrame:
    """The same counts in long form: (group..., column, bad) for the columns that have bad values."""
    return (
        df.filter(F.col(BAD).isNotNull()).select(*by, F.explode(BAD).alias("column"))
        .filter(F.col("column").isin(list(columns))).groupBy(*by, "column").agg(F.count("*").alias("bad"))
    )


def band_select(df: DataFrame, column: str, lo: float, hi: float | None = None, error: str | None = None,
                min_ratio: float = 10.0, limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows with lo < column <= hi and a signal-to-noise ratio above `min_ratio`, largest first (then by `tie`)."""
    require(hi is None or hi > lo, f"upper edge {hi} must be above lower edge {lo}")
    require(limit is None or limit >= 1, "limit must be 1 or more")
    out = df.filter(F.col(column) > lo)
    if hi is not None:
        out = out.filter(F.col(column) <= hi)
    if error is not None:
        out = out.filter(F.try_divide(F.col(column), F.col(error)) > min_ratio)
    out = out.orderBy(F.col(column).desc(), *([F.col(tie)] if tie else []))
    return out if limit is None else out.limit(limit)


def write_clean(df: DataFrame, lake: str, source: str, dataset: str) -> str:
    """Typed Parquet, one partition per raw file; a second run replaces only the files it holds.

    Needs `path` from the scan. The row order and the bad-value list are stored too, so reports and the
    last-row-wins rule can be answered from the clean layer alone.
    """
    target = f"{lake.rstrip('/')}/clean/{source}/{dataset}"
    fetch_date, raw_file = last_parts()
    out = df.withColumns({"fetch_date": fetch_date, "raw_file": raw_file}).drop("path")
    # Parsing many columns makes long methods, which ran at half the speed where they were not compiled.
    conf = df.sparkSession.conf
    limit = conf.get(_METHOD_LIMIT, None)
    conf.set(_METHOD_LIMIT, _COMPILED_BYTES)
    try:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fetch_date", "raw_file").parquet(target)
    finally:
        conf.unset(_METHOD_LIMIT) if limit is None else conf.set(_METHOD_LIMIT, limit)
    return target


def lineage_name(filename: Column) -> Column:
    """Name of the clean file a raw file becomes: extension replaced."""
    return F.concat(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), F.lit(".parquet"))


def read_clean(spark, lake: str, source: str, dataset: str, schema: dict[str, T.DataType]) -> DataFrame:
    """Clean rows with `_bad`, `_row_pos`, `fetch_date`, `raw_file` and the lineage column `_source_file`."""
    for name in schema:
        check_name(name)
    df = spark.read.option("basePath", f"{lake.rstrip('/')}/clean/{source}/{dataset}").schema(
        T.StructType([*[T.StructField(n, t) for n, t in schema.items()],
                      T.StructField("_row_pos", T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.LongType())])),
                      T.StructField(BAD, T.ArrayType(T.StringType())),
                      T.StructField("fetch_date", T.StringType()), T.StructField("raw_file", T.StringType())])
    ).parquet(f"{lake.rstrip('/')}/clean/{source}/{dataset}")
    return df.withColumn("_source_file", lineage_name(F.col("raw_file")))
