"""Registered queries of the library and their SQL."""

from __future__ import annotations

from graphloom.plans import files, learning, literature, reports, tables
from graphloom.plans.demo import oracle

_ALL = {**reports.QUERIES, **tables.QUERIES, **literature.QUERIES, **learning.QUERIES, **files.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: oracle(sql) for name, (_, sql) in _ALL.items() if sql}
