"""Every registered query of the library and its DuckDB SQL."""

from __future__ import annotations

from .plans import matching, text

_ALL = text.QUERIES | matching.QUERIES

QUERIES: dict = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
