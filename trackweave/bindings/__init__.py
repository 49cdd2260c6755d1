"""Every operator bound to the given tables."""

from trackweave.bindings import ingest_queries, recommend_queries, transform_queries, vector_queries  # noqa: F401
from trackweave.bindings.registry import QUERIES

__all__ = ["QUERIES"]
