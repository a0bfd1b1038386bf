"""Names every query of the library, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.plans import catalog, contents, duplicates, library, lookups, sessions

_MODULES = (duplicates, sessions, contents, library, lookups, catalog)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "duplicate_groups"
