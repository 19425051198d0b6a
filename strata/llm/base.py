"""Registration of the subpackage's queries and the few helpers its operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space of the contracts, [\x20\x09-\x0D]; bytes.split() and bytes.strip() without arguments use the same six characters.
BLANKS = " \t\n\x0b\x0c\r"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are kept small because one row may be a very long text."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) > 2000:
        spark.conf.set(ARROW_ROWS, "2000")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for steps whose Python objects are many times as large as the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`."""
    def keep(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            small_batches(spark)
            return fn(use_utc(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that further columns of the input cannot clash; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): every other column goes into one struct, so that its name cannot clash on the way."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that `packed` was given, with n_chars, if it is one of them, counted anew."""
    def column(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        return F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("rest").getField(c).alias(c)

    return rows.select(*map(column, columns))


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def spans_text(spans: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """kind:start:end of each span, joined by commas; `spans` is an array of structs in the wanted order."""
    chosen = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digest(spans: Column, base_kinds: tuple[str, ...]) -> list[Column]:
    """The columns that both span contracts ask for: counts of base kinds, digest of base spans, all spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = spans_text(spans, lambda s: s["kind"].isin(*base_kinds))
    return [*map(count, base_kinds), F.sha2(base, 256).alias("base_sha256"), spans_text(spans).alias("spans")]


SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"
