"""Named queries over the test tables, each next to the SQL it must agree with."""

from emberlog.workload import alerts, ingest, metrics, search, sketches, streams, tiering  # noqa: F401
from emberlog.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
