"""Every registered query with its SQL oracle."""

from __future__ import annotations

from .plans import roundtrips  # noqa: F401: registers its queries
from .plans.oracles import ORACLE_SQL
from .plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
