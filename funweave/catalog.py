"""The registered queries of the core and the SQL they are held against."""

from __future__ import annotations

from funweave.plans import pipeline_queries, problem_queries

QUERIES = pipeline_queries.QUERIES | problem_queries.QUERIES
SQL = pipeline_queries.SQL | problem_queries.SQL
