"""Where the query modules register: name -> callable(spark, sf_dir) and its DuckDB twin."""

from __future__ import annotations

from ringdata.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql starts after the common views (a further CTE starts with a comma)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = views.SQL + sql
        return f

    return add
