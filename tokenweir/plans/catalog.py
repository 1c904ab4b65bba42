"""The registry of queries and of the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenweir.plans import engine_queries, ledger_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (ledger_queries, text_queries, engine_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
