"""Every query of the core by name, with its SQL where the rows can be had in SQL as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeline.plans import assist, compare, graph, quality, relational, search, sources, text, units

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

for _module in (text, search, relational, graph, quality, sources, assist, compare, units):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
FLAGSHIP = "f1_hybrid"
