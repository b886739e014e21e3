"""Every operator as a query over the test tables, each with its SQL counterpart."""

from haulage.queries import (  # noqa: F401  (importing registers the queries)
    accounting,
    cleaning,
    exports,
    logs,
    planning,
    profiling,
    scans,
    streams,
    verification,
)
from haulage.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
