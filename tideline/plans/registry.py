"""All queries of the ranking engine, and the SQL of those that SQL can express."""

from __future__ import annotations

from tideline.plans import batch, evaluation, formats, models, ranking, timeseries

MODULES = [ranking, timeseries, evaluation, models, batch, formats]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
