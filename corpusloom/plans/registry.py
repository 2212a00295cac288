"""All registered queries and their check SQL."""

from __future__ import annotations

from . import index_plans, job_plans, page_plans, search_plans, text_plans

_PARTS = (text_plans, page_plans, index_plans, job_plans, search_plans)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
