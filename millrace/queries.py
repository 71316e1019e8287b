"""Every registered warehouse query, with its SQL where SQL can express it."""

from __future__ import annotations

from millrace.plans import daily, dashboards, detail, dims, exchange, facts, freight, late, loading, logistics, runs, scalars, states, streams, trade, windows

_MODULES = (trade, logistics, freight, facts, detail, dims, daily, dashboards, scalars, streams, windows, runs, late, states, exchange, loading)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
