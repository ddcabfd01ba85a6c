"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from . import composites, desk, intake, landed, pricing, relational, scalars, site, stored
from .base import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (pricing, scalars, relational, composites, landed, site, desk, intake, stored):
    QUERIES |= _module.book.queries
    ORACLE_SQL |= _module.book.oracle_sql
