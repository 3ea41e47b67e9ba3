"""All registered queries of the library."""

from __future__ import annotations

from . import dom_queries, gate_queries, package_queries, review_queries, semantics_queries, table_queries, text_queries  # noqa: F401
from .common import REGISTRY

QUERIES = {name: q.run for name, q in sorted(REGISTRY.items())}
ORACLE = {name: q.sql for name, q in sorted(REGISTRY.items()) if q.sql}
