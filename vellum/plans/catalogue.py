"""All registered queries of the library's own operators, with SQL for each."""

from __future__ import annotations

from vellum.plans import block_queries, catalog_queries, notation_queries, page_queries, run_queries, source_queries

MODULES = [catalog_queries, run_queries, block_queries, notation_queries, page_queries, source_queries]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
