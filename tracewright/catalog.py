"""Every query of the package outside its training-data operators, with its SQL."""

from __future__ import annotations

from tracewright.plans import checks, decisions, features, identity, models, outcomes, relations, sources, splits, windows  # noqa: F401
from tracewright.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "g10_decisions"
