"""The registered queries over the tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """(queries, SQL) by name."""
    from . import audits, graphs, rules, sparql, texts, upkeep

    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for module in (sparql, texts, graphs, audits, rules, upkeep):
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
