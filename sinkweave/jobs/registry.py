"""Registered queries of the code-audit operators and their oracle SQL."""

from __future__ import annotations

from sinkweave.jobs import queries_audit, queries_extract, queries_index, queries_structure


def queries() -> dict:
    return queries_index.QUERIES | queries_extract.QUERIES | queries_audit.QUERIES | queries_structure.QUERIES


def oracle_sql() -> dict[str, str]:
    return queries_index.ORACLE | queries_extract.ORACLE | queries_audit.ORACLE | queries_structure.ORACLE
