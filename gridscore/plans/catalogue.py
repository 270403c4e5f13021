"""All registered queries of the library's own operators, and the SQL that each is held against."""

from gridscore.plans import queries_connect, queries_metrics, queries_score, queries_search, queries_signal, queries_space, queries_time, queries_validation  # noqa: F401
from gridscore.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
