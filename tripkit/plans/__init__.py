"""Registered queries: operators bound to tables, each with its check in SQL where SQL can say it."""

from tripkit.plans.register import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
