"""The registered queries and their SQL."""

from tidemark.plans import model_queries, network_queries, search_queries, source_queries, text_queries, trend_queries

_MODULES = (trend_queries, search_queries, network_queries, text_queries, model_queries, source_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
