"""Registry of named queries and the composer of their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kpisleuth.session import sized


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``sql`` may use any name in VIEWS."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = Query(lambda spark, folder: fn(sized(spark), folder), sql)
        return fn

    return register


def compose(sql: str) -> str:
    """Prefix a statement with the views it uses, in dependency order."""
    ordered: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b\w+_v\b", text):
            if name in VIEWS and name not in seen:
                seen.add(name)  # a view that names itself is recursive
                visit(VIEWS[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    heads = ",\n".join(f"{name} AS (\n{VIEWS[name].strip()}\n)" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):  # its own tables follow the views
        return f"WITH RECURSIVE {heads},\n{body[5:].lstrip().removeprefix('RECURSIVE ')}"
    return f"WITH RECURSIVE {heads}\n{body}"
