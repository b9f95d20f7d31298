"""Registered queries over the given tables, each with the SQL that checks it where SQL can."""

from seqloom.plans import corpora, datasets, examples, ranking, reports
from seqloom.plans.registry import queries, sql

__all__ = ["corpora", "datasets", "examples", "queries", "ranking", "reports", "sql"]
