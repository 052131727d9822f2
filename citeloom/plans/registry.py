"""All registered queries and their oracle SQL."""

from __future__ import annotations

from citeloom.plans import answering, facility_search, ingest, operations, search, streams

_AREAS = [ingest, search, answering, operations, facility_search, streams]

QUERIES = {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
