"""All registered queries."""

from . import queries_search, queries_text

_MODULES = (queries_search, queries_text)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
