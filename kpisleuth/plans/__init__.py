"""Named queries over a directory of tables, with their SQL twins."""

from __future__ import annotations


def all_queries():
    """Every registered query, in registration order."""
    from kpisleuth.plans import registry, views  # noqa: F401
    from kpisleuth.plans import cases, facts, operations, verdicts  # noqa: F401

    return registry.QUERIES
