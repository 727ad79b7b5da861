"""Registered queries of the library and the SQL they are compared with."""

from __future__ import annotations

from tessera.jobs import evaluation, exchange, indexing, maintenance, preparation, retrieval, scalars

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, evaluation, maintenance, preparation, scalars, exchange, indexing):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

FLAGSHIP = "q7_hybrid_search"
