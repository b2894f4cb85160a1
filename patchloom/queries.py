"""All queries and their SQL; domain and code_queries add their own to the registry."""

from .plans import code_queries, domain, registry

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "code_queries", "domain"]
