"""Registered queries. ``load()`` returns them with their SQL."""


def load() -> tuple[dict, dict]:
    from . import flagship, quality_queries, relational_queries, segment_queries  # noqa: F401
    from .registry import ORACLE, QUERIES

    return QUERIES, ORACLE
