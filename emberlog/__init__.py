"""Log ingestion, tiering, search and operational analytics as Spark jobs."""

from emberlog.plans.query import LogQuery, Route
from emberlog.plans.search import search, summarize
from emberlog.schema import LOG_SCHEMA
from emberlog.sources.tables import LogTables

__all__ = ["LOG_SCHEMA", "LogQuery", "LogTables", "Route", "search", "summarize"]
