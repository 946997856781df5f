"""All core queries and their SQL."""

from __future__ import annotations

from . import browsing, forests, searching, terms, workflow

MODULES = [forests, browsing, terms, searching, workflow]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
