"""Ordered results. Every order ends in a key, so the outcome does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strata.functions.names import require


def top_k(df: DataFrame, by, k: int | None = None, desc: bool = False, tie=()) -> DataFrame:
    """The first k rows by one or more columns, ties by further columns upwards; one heap per task, no full sort when k is given."""
    require(k is None or k >= 1, "k must be 1 or more")
    names = [by] if isinstance(by, str) else list(by)
    order = [F.col(n).desc() if desc else F.col(n).asc() for n in names]
    ties = [tie] if isinstance(tie, str) else list(tie or ())
    out = df.orderBy(*order, *[F.col(t).asc() for t in ties])
    return out if k is None else out.limit(k)


def rank_candidates(df: DataFrame, score: str, key: str, k: int | None = None) -> DataFrame:
    """Highest score first, smaller key among equals."""
    return top_k(df, score, k, desc=True, tie=key)


def examples(df: DataFrame, predicate: Column | str, n: int, key=()) -> DataFrame:
    """n rows that match a rule; with a key the choice is the smallest keys instead of any rows."""
    require(n >= 1, "n must be 1 or more")
    hit = df.filter(predicate)
    names = [key] if isinstance(key, str) else list(key)
    return (hit.orderBy(*names) if names else hit).limit(n)


def by_weight(df: DataFrame, weight: str = "weight", name: str = "feature") -> DataFrame:
    """Weights by absolute size, largest first."""
    return df.orderBy(F.abs(F.col(weight)).desc(), F.col(name))
