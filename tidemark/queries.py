"""Named queries over the test tables and their oracle SQL. Each family is a module of plans."""

from __future__ import annotations

from tidemark.plans import captions, displays, edits, timelines

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _family in (captions, timelines, displays, edits):
    QUERIES |= _family.QUERIES
    ORACLE_SQL |= _family.ORACLE_SQL
