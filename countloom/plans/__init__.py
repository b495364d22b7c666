"""Registered queries: each operator over the whole star-schema tables, with the SQL that gives the same rows."""

from countloom.plans import more, processes, tables, wide

_MODULES = (tables, processes, more, wide)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
