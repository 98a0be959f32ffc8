"""Every registered query and its SQL."""

from __future__ import annotations

from placelens.plans import areas, costs, discovery, documents, families, linkages, listings, offered, places, records, relational, reports, search, sessions, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _plans in (areas, discovery, families, linkages, offered, sessions, relational, search, texts, costs, documents, places, records, reports, listings):
    QUERIES |= _plans.QUERIES
    ORACLE_SQL |= _plans.ORACLE_SQL
