"""The registered queries of the library's operators, and their SQL."""

from __future__ import annotations

from . import calculations, files, models, profiling, relations, sheets, state, views

_MODULES = (profiling, relations, calculations, views, models, state, sheets, files)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
