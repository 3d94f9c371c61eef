"""All queries of the library's own operators, by name."""

from __future__ import annotations

from sievework.plans import more  # noqa: F401  (adds its queries)
from sievework.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
