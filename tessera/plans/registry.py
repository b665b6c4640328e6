"""All queries of the engine and the SQL that checks each of them."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL, in which names of relations stand for their definitions."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_relations(sql)
        return f

    return add


def with_relations(sql: str) -> str:
    """Put the definitions of the relations that a statement names before it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in relations.SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(relations.SQL[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{n} as ({relations.SQL[n].strip()})" for n in need)
    body = sql.strip()
    if body.startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    return f"with {ctes}, {body[5:]}" if body.startswith("with ") else f"with {ctes} {body}"


for _module in ("versioned", "maintenance", "dedup", "trace", "tree", "catalog", "metrics", "streams", "states", "surface"):
    importlib.import_module(f"tessera.plans.{_module}")
