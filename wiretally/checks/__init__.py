"""Registered queries and the SQL they are checked against."""

from wiretally.checks import (  # noqa: F401
    catalog,
    pages,
    payloads,
    signals,
    specs,
    timeline,
    traffic,
)
from wiretally.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
