"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import curation, evaluation, manifest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (manifest, curation, evaluation):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.SQL
