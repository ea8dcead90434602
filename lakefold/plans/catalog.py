"""All registered queries and the SQL that each must agree with."""

from __future__ import annotations

from . import aggregate, relational, scalar, streams  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
