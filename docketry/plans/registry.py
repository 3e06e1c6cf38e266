"""Every query of the engine by name, and the SQL that gives the same rows."""

from docketry.plans import answers, catalog, evaluations, locks, matters, payloads, people, search, stated

QUERIES, ORACLE_SQL = catalog.QUERIES, catalog.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "answers", "catalog", "evaluations", "locks", "matters", "payloads", "people", "search", "stated"]
