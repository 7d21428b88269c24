"""All queries of the core with the SQL that states each (survey §7.6)."""

from __future__ import annotations

from . import bank_queries, cluster_queries, score_queries, text_queries

_MODULES = (text_queries, score_queries, cluster_queries, bank_queries)


def queries():
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
