"""Every query of the engine and its SQL, gathered from the operator modules."""

from __future__ import annotations

from codelake.functions import text
from codelake.operators import aggregates, extraction, graph, joins, lookups, ranking, retrieval, supplement, vectors
from codelake.sources import files
from codelake.streaming import incremental

FLAGSHIP = "j02_dashboard"
_MODULES = (lookups, aggregates, joins, ranking, vectors, retrieval, graph, extraction, supplement, text, files, incremental)
QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
