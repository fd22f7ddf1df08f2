"""Queries over the test tables and the SQL they are checked against."""

from pairmatch.plans import (  # noqa: F401  (importing registers the queries)
    feature_queries,
    learning_queries,
    source_queries,
    table_queries,
    text_queries,
)
from pairmatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
