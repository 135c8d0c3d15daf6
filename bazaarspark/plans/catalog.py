"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from bazaarspark.plans import eval_queries, order_queries, retrieval_queries, search_queries

MODULES = [order_queries, search_queries, retrieval_queries, eval_queries]


def queries() -> dict[str, Callable]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
