"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from . import cooccurrence, encodings, languages, leakage, mixture, neardup, scans, survivors

MODULES = [survivors, cooccurrence, leakage, neardup, encodings, languages, scans, mixture]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
