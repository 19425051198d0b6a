"""Strata: raw -> clean -> curated tables and sky analytics as Spark jobs."""

from strata.session import build_session, scratch_dir, write_scratch

__all__ = ["build_session", "scratch_dir", "write_scratch"]
