"""Every registered query of the knowledge engine, and the same rows in SQL."""

from __future__ import annotations

from . import contracts, packs, reads, work, worlds

_PARTS = (reads, work, packs, worlds, contracts)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
