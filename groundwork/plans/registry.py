"""Queries and their DuckDB twins, by name, over all operator families."""

from __future__ import annotations

from collections.abc import Callable

from groundwork.plans import activity, dag, events, grounding, ingest, retrieval, sources

FAMILIES = (grounding, retrieval, ingest, activity, sources, dag, events)
QUERIES: dict[str, Callable] = {k: v for m in FAMILIES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in FAMILIES for k, v in m.ORACLES.items()}
