"""Queries and SQL of the operators, for the driver's contract."""

from __future__ import annotations

from linkwright.llm import q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13

_MODULES = [q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
