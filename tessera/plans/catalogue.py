"""All queries of the engine and the SQL for them."""

from __future__ import annotations

from tessera.plans import answers, decided, families, library, pools, records, scopes, search, tasks  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
