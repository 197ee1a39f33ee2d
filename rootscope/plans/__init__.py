"""Registered queries of the library's operators."""

from . import signals_logs, sources_streams, telemetry, traces_rca  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
