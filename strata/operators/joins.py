"""Joins of the curated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions.names import check_key, require
from strata.functions.scalars import trailing_id


def join_on_text_id(left: DataFrame, text: str, right: DataFrame, id_column: str) -> DataFrame:
    """Inner join on the number at the end of a text column; rows without a number match nothing."""
    keyed = left.withColumn("_text_id", trailing_id(text)).filter(F.col("_text_id").isNotNull())
    return keyed.join(right, keyed["_text_id"] == right[id_column]).drop("_text_id")


def join_on_name(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a shared string key."""
    return left.join(right, check_key(key, left.columns))


def attach_errors(stars: DataFrame, errors: DataFrame | None = None, key: str = "source_id") -> DataFrame:
    """Add the error-bar columns where they exist; without an error table the stars come back unchanged."""
    return stars if errors is None else stars.join(errors, key, "left")


def existing_rows(incoming: DataFrame, table: DataFrame, key) -> DataFrame:
    """Incoming rows whose key is already in the table."""
    names = check_key(key, incoming.columns)
    return incoming.join(table.select(*names), names, "left_semi")


def count_existing(incoming: DataFrame, table: DataFrame, key) -> DataFrame:
    return existing_rows(incoming, table, key).agg(F.count("*").alias("updated"))


def without_keys(table: DataFrame, incoming: DataFrame, key) -> DataFrame:
    """Table rows that the incoming rows do not replace."""
    names = check_key(key, table.columns)
    return table.join(incoming.select(*names), names, "left_anti")


def label_members(df: DataFrame, id_column: str, members: DataFrame, name: str = "label") -> DataFrame:
    """1 for rows whose id is among the members, else 0."""
    known = members.select(F.col(id_column)).filter(F.col(id_column).isNotNull()).distinct().withColumn("_member", F.lit(1))
    return df.join(known, id_column, "left").withColumn(name, F.coalesce("_member", F.lit(0))).drop("_member")


def lookup_default(df: DataFrame, other: DataFrame, key: str, value: str, default: float) -> DataFrame:
    """Left lookup of a unique key with a default for absent rows."""
    return df.join(other.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def pending(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Slices of the plan that are not done yet, in plan order."""
    require("ord" in plan.columns and "slice_id" in plan.columns, "a plan needs ord and slice_id")
    return plan.join(ledger.select("slice_id"), "slice_id", "left_anti").orderBy("ord")
