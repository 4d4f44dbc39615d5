"""All queries of the engine's own operators, with their oracle SQL."""

from __future__ import annotations

from .plans import code, model, queries

QUERIES = queries.QUERIES | model.QUERIES | code.QUERIES
ORACLES = queries.ORACLES | model.ORACLES
