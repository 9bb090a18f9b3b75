"""All registered queries and the SQL that tells the same rows."""

from __future__ import annotations

from tessera.plans import flows, measures, operations, reports, retrieval, stores, texts, timelines

MODULES = (retrieval, texts, timelines, measures, operations, reports, stores, flows)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
