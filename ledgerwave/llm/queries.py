"""All registered queries of this subpackage."""

from . import mining_queries, near_queries, text_queries, token_queries  # noqa: F401  (registration)
from .registry import CHECKS, QUERIES

__all__ = ["QUERIES", "CHECKS"]
