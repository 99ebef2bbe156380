"""All of the library's queries and their SQL."""

from lectern import core_queries, index_queries, more_queries, nesting_queries, note_queries, profile_queries, resolution_queries, rule_queries, state_queries  # noqa: F401  add their queries
from lectern.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
