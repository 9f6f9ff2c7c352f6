"""All queries of the library and their DuckDB twins."""

from __future__ import annotations

from ringdata.plans import q_basic, q_graph, q_learn, q_pairs, q_reports, q_sampling, q_streams  # noqa: F401  (they register)
from ringdata.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
