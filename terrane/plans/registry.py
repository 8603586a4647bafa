"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from . import core, data, evaluate, features, files, histories, labels, profiles, series, shapes, spans, strata, stream, trades

_MODULES = (core, series, data, labels, stream, features, evaluate, shapes, files, trades, profiles, histories, spans, strata)
QUERIES: dict = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
