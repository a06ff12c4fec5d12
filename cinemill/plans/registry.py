"""Names of the registered queries, their functions and the SQL that checks them."""

from __future__ import annotations

from cinemill.sources.library import oracle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame; sql may use the library views by name."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(" ".join(sql.split()))
        return f

    return put
