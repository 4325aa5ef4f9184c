"""Registry of runnable plans and their SQL counterparts.

A plan is a function ``(spark, sf_dir) -> DataFrame``.  Its SQL text is assembled from
named common table expressions, so that both sides start from the raw tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.session import compiled_methods, measured_broadcasts, plain_unions

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    """Name a reusable SQL table expression and the ones it is built on."""
    _CTES[name] = (needs, body.strip())


def with_ctes(needs: tuple[str, ...], body: str, recursive: bool = False) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _CTES[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{name} AS (\n{_CTES[name][1]}\n)" for name in ordered)
    head = "WITH RECURSIVE" if recursive else "WITH"
    text = body.strip()
    if text[:5].upper() == "WITH ":
        return f"{head} {parts},\n{text[5:]}"
    return f"{head} {parts}\n{text}"


def _prepared(func: Plan) -> Plan:
    @wraps(func)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plain_unions(spark)
        measured_broadcasts(spark)
        compiled_methods(spark)
        return func(spark, sf_dir)

    return run


def plan(name: str, sql: str | None = None, needs: tuple[str, ...] = (), recursive: bool = False):
    """Register a plan, with its SQL counterpart where one exists."""

    def register(func: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = _prepared(func)
        if sql is not None:
            SQL[name] = with_ctes(needs, sql, recursive)
        return func

    return register
