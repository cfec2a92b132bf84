"""Queries over the given tables by name, and DuckDB SQL for their results."""

from __future__ import annotations

from dossier.plans import evidence, graphs, relational, texts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (relational, graphs, texts, evidence):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
