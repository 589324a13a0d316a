"""All queries of the engine and the SQL they are held against."""

from __future__ import annotations

from corpusloom.plans import entities, graph, relations, scores, tables, text

_PARTS = (graph, text, entities, relations, tables, scores)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
