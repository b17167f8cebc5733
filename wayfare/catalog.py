"""Registered queries of the street-network operators, with the SQL that checks them."""

from __future__ import annotations

from wayfare.workloads import build, exchange, live, network, paths, reports, requests, shapes, spatial, streams, surface, upkeep

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (network, paths, spatial, shapes, streams, live, reports, requests, build, surface, exchange, upkeep):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL

flagship = paths.compared
