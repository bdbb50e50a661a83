"""Quantities in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeline.operators.units import find_quantities, to_common
from lodeline.runtime import table


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_quantities(table(spark, sf_dir, "procedure_summaries"), "procedure_summary_id")
    return to_common(found, table(spark, sf_dir, "unit_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_values(spark, sf_dir).where("converted").select("procedure_summary_id", "field_name", "item_pos", "quantity").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_values)}
SQL: dict[str, str] = {}
