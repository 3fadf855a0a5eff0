"""Ledgerloom: governed analytical data products as plain Spark jobs."""

from ledgerloom.context import RunContext
from ledgerloom.session import build_session, durable_dir

__all__ = ["RunContext", "build_session", "durable_dir"]
