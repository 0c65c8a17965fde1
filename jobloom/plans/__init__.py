"""Query registry: importing this package registers every named query."""

from . import ats, board, bundles, ingest, intake, relevance, similarity, streams, text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
