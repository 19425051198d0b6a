"""Registered queries over the given tables, each with the SQL that answers it on one machine where there is one."""

from strata.workload import analytics, curated, landing, loading, relational  # noqa: F401
from strata.workload.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
