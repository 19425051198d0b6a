"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions.names import require


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    for other in others:
        first = first.unionByName(other)
    return first


def concat_pages(pages: list[DataFrame] | DataFrame, page: str = "page", pos: str = "pos") -> DataFrame:
    """One ordered record set from pages that carry their page number and position."""
    rows = pages if isinstance(pages, DataFrame) else union_by_name(*pages)
    return rows.orderBy(page, pos)


def compare_tables(a: DataFrame, b: DataFrame, multiset: bool = False) -> DataFrame:
    """One row (rows_a, rows_b, only_a, only_b, same): a two-way EXCEPT over the columns of `a`.

    Both tables go through one grouped count, so equal rows collapse before the only shuffle and copies of one
    row cannot pile up in a task. With `multiset`, differing numbers of copies count as a difference too.
    """
    names = a.columns
    absent = sorted(set(names) - set(b.columns))
    require(not absent, f"columns missing from the second table: {absent}")
    sides = a.select(*names, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*names, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    rows = sides.groupBy(*names).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    if multiset:
        only_a, only_b = F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))), F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0)))
    else:
        only_a, only_b = F.count_if(F.col("_b") == 0), F.count_if(F.col("_a") == 0)
    totals = rows.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("rows_b"),
        F.coalesce(only_a, F.lit(0)).alias("only_a"), F.coalesce(only_b, F.lit(0)).alias("only_b"),
    )
    same = (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("rows_a") == F.col("rows_b"))
    return totals.withColumn("same", same)
