"""Every query of the core with its SQL, by name."""

from __future__ import annotations

from corpusloom.plans import manifest_queries, snapshot_queries, text_queries

_MODULES = (snapshot_queries, text_queries, manifest_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
