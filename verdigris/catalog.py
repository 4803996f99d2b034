"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import answer_queries, audit_queries, code_queries, evidence_queries, lane_queries, packet_queries, retrieval_queries, rule_queries, state_queries, text_queries

QUERIES = text_queries.QUERIES | retrieval_queries.QUERIES | audit_queries.QUERIES | state_queries.QUERIES | evidence_queries.QUERIES | rule_queries.QUERIES | answer_queries.QUERIES | code_queries.QUERIES | lane_queries.QUERIES | packet_queries.QUERIES
ORACLE_SQL = text_queries.SQL | retrieval_queries.SQL | audit_queries.SQL | state_queries.SQL | evidence_queries.SQL | rule_queries.SQL | answer_queries.SQL | code_queries.SQL | lane_queries.SQL | packet_queries.SQL
FLAGSHIP = "lex_bm25_or"
