"""The subpackage's registered queries: importing the operators registers them."""

from strata.llm import bpe, divergence, html, lines, packing, pii, quality, secrets, simhash, substrings, topk, toxicity, whitening  # noqa: F401
from strata.llm.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
