"""Every query of this subpackage with its SQL, by name."""

from __future__ import annotations

from corpusloom.llm import oracles, queries

QUERIES = queries.QUERIES
ORACLES = oracles.ORACLES
