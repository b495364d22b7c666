"""All queries of this subpackage, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from countloom.llm import bpe, decontam, langid, linededup, lm, neardup, quality, sharding, toxicity, urlfilter

_MODULES = (quality, lm, toxicity, sharding, bpe, linededup, langid, decontam, urlfilter, neardup)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
