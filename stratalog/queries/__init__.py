"""Registered queries of the catalogue, by subject."""

from . import bookkeeping, context, evidence, extraction, lookups, search, sessions, temporal
from .registry import QUERIES

__all__ = ["QUERIES", "bookkeeping", "context", "evidence", "extraction", "lookups", "search", "sessions", "temporal"]
