"""All queries of the engine and their SQL."""

from __future__ import annotations

from footfall.plans import demand, documents, flows, functions, network, roads, scans, series, spatial, steps

_PARTS = (series, flows, demand, functions, spatial, network, roads, documents, scans, steps)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
