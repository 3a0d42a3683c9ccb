"""All queries with their oracle SQL (None where SQL cannot express them)."""

from __future__ import annotations

from . import audit_queries, boosting_queries, contract_queries, event_queries, family_queries, history_queries, model_queries, pool_queries, quality_queries, report_queries, state_queries

QUERIES: dict = {**history_queries.QUERIES, **quality_queries.QUERIES, **pool_queries.QUERIES, **model_queries.QUERIES, **event_queries.QUERIES, **report_queries.QUERIES, **state_queries.QUERIES, **boosting_queries.QUERIES, **contract_queries.QUERIES, **audit_queries.QUERIES, **family_queries.QUERIES}
