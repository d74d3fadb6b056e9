"""The query registry and the SQL views its checks are written over."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .bindings import Bindings
from .views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    build: Callable[[Bindings], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def with_views(body: str) -> str:
    """Prefix a SELECT with the views it names, and those they name."""
    needed: list[str] = []

    def need(text: str) -> None:
        for view in VIEWS:
            if re.search(rf"\b{view}\b", text) and view not in needed:
                need(VIEWS[view])
                needed.append(view)

    need(body)
    if not needed:
        return body
    views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    extra = re.match(r"\s*WITH\s+", body)
    return f"WITH {views}, {body[extra.end():]}" if extra else f"WITH {views} {body}"


def query(name: str, *operators: str, sql: str | None = None):
    """Register a query under a name, with the operators it covers and its check."""

    def add(build: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, operators, build, with_views(sql) if sql else None)
        return build

    return add
