"""The query catalogue: each query with the SQL that must give the same rows."""

from gridlens.plans import (  # noqa: F401
    charts,
    evaluation,
    preparation,
    profiling,
    reports,
    texts,
    training,
)
from gridlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
