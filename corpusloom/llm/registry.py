"""All registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from . import queries_groups, queries_models, queries_native

_PARTS = (queries_native, queries_models, queries_groups)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
