"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from tideline.llm import gru, lines, mixing, pieces, quality, secrets, simhash, telephony, toxicity, urls

MODULES = [secrets, quality, mixing, lines, toxicity, urls, simhash, gru, telephony, pieces]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
