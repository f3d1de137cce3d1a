"""Registered queries with their oracle SQL."""

from . import catalog, files, judge, search, streams
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "catalog", "files", "judge", "search", "streams"]
