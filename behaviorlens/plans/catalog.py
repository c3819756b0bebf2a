"""Registered queries over the star-schema test tables, with their SQL twins."""

from __future__ import annotations

from behaviorlens.plans import daily_queries, evaluation_queries, graph_queries, ingest_queries, message_queries, serving_queries, training_queries

_MODULES = (daily_queries, evaluation_queries, graph_queries, ingest_queries, message_queries, serving_queries, training_queries)
QUERIES = {n: q for m in _MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: q for m in _MODULES for n, q in m.ORACLES.items()}
