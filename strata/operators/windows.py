"""Row choice per key. A row_number filter lets Spark drop losing rows before the shuffle, so hot keys stay cheap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.names import check_key

_RANK = "_strata_rank"


def _first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) == 1).drop(_RANK)


def drop_null_keys(df: DataFrame, key) -> DataFrame:
    return df.dropna(subset=check_key(key, df.columns))


def last_per_key(df: DataFrame, key, order) -> DataFrame:
    """The row with the greatest `order` (column name or list) per key; rows without a full key are dropped."""
    names = check_key(key, df.columns)
    columns = [order] if isinstance(order, str) else list(order)
    return _first_per(drop_null_keys(df, names), names, [F.col(c).desc() for c in columns])


def latest_wins(df: DataFrame, key, order=("_fetched_at", "path", "_row_pos")) -> DataFrame:
    """Replay of many fetches at once: the newest fetch wins, then the later path, then the later row.

    Equal to upserting the files one after the other, because an upsert replaces whole rows.
    """
    return last_per_key(df, key, list(order))


def nearest_per_entity(df: DataFrame, entity: str, distance: str, tie: str) -> DataFrame:
    """The closest row per entity, smaller `tie` first among equals."""
    return _first_per(df, check_key(entity, df.columns), [F.col(distance).asc(), F.col(tie).asc()])


def with_candidate_count(df: DataFrame, entity: str, name: str = "candidates") -> DataFrame:
    """How many rows each entity has. Counted map-side and joined back, so a hot entity is never one window."""
    counts = df.groupBy(entity).agg(F.count("*").alias(name))
    return df.join(counts, entity)
