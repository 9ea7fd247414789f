"""Every query of the library by name, and the SQL that DuckDB answers it with."""

from __future__ import annotations

from .plans import cascades, catalogue, evidence, feed, forms, inline, judging, matching, origins, pairings, predicates, publishing, refresh, rules, search, shelves, stores, upserts

_MODULES = (catalogue, refresh, matching, evidence, origins, pairings, inline, cascades, predicates, rules, search, shelves, stores, upserts, forms, judging, feed, publishing)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
