"""Named queries over the sales tables and the SQL that checks them."""

from . import analysis_queries, curation_queries, series_queries  # noqa: F401  (registration)
from .registry import CHECKS, QUERIES

__all__ = ["QUERIES", "CHECKS"]
