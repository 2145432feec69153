"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import deck_queries, dispatch_queries, layout_queries, record_queries, relational_queries, slot_queries, text_queries

MODULES = (text_queries, deck_queries, relational_queries, slot_queries, record_queries, layout_queries, dispatch_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
